"""The trie of conversation prefixes, its subtrees summed by peeling leaves.

A node of depth d is a distinct sequence of the first d turns. It is found
without gathering a conversation: every turn is hashed with its position, and
the running sums of these hashes (four of 32 bits) name the prefix. Running
sums are taken by ranges (``operators/neighbours.py``), so a conversation may
hold a third of all turns.

Nodes are known by (smallest member, depth). The nodes that share a smallest
member are one run of depths on one way down, and a run is what peeling moves:
it holds a counter of the runs that hang on it; runs without any left send
their totals to the parent's run and are done, until only the root's run
finishes. So rounds do not grow with the length of conversations (one that
nothing branches off is done in the first round), and a round touches open runs
only. Inside runs, totals of subtrees are running sums from below.

Defined cases: rows without a conversation id belong to none; a null role or
text is empty; turns of equal number follow each other by role, then by the
SHA-256 of the text, and repeated rows are turns of their own; extra columns are
ignored; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.neighbours import running_totals
from tessella.session import drop_scratch, materialize

PARTS = 4
#: Ids of conversations that end at one node are joined to texts by runs of so many before their digest is streamed.
IDS = 256
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """How many runs of characters other than space and \\t to \\r a text has."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, sha, words): the turns of every conversation in order, from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id is not null")
    sha = F.sha2(F.concat(F.length("role").cast("string"), F.lit("\x1f"), "role", "text"), 256)
    thin = said.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha"), sha.alias("sha"), words(F.col("text")).alias("words"), F.lit(1).cast("long").alias("one"))
    return running_totals(thin, ["conv_id"], ["turn", "role", "text_sha"], {"pos": "one"}).select("conv_id", "pos", "sha", "words")


def share_openings(placed: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first crc32(id) mod ``most`` turns of conversation id - id mod ``block``, then the own turns after as many.

    Returns (conv_id, depth, sha, words), and (conv_id) of all conversations.
    """
    placed = materialize(placed, "turns")
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    held = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    convs = materialize(convs.select("conv_id", "own", held.alias("held"), (F.col("conv_id") - F.col("conv_id") % block).alias("base")), "conversations")
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    known = convs.join(lengths, "base", "left").withColumn("taken", F.least("held", F.coalesce("base_own", F.lit(0))))
    first = placed.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "sha", "words")
    opened = known.where("taken > 0").select("conv_id", "base", "taken").join(first, "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "sha", "words")
    rest = placed.join(known.select("conv_id", "held", "taken"), "conv_id").where("pos > held")
    return opened.unionByName(rest.select("conv_id", (F.col("pos") - F.col("held") + F.col("taken")).alias("depth"), "sha", "words")), convs.select("conv_id")


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, words) with the root, and (conv_id, node_conv, depth): where conversations end."""
    mixed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit("\x1f"), "sha"), 256)
    own = [F.conv(F.substring("mixed", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"own_{i}") for i in range(PARTS)]
    hashed = turns.withColumn("mixed", mixed).select("conv_id", "depth", "words", *own)
    chained = materialize(running_totals(hashed, ["conv_id"], ["depth"], {f"sum_{i}": f"own_{i}" for i in range(PARTS)}), "prefixes")
    sums = [f"sum_{i}" for i in range(PARTS)]
    before = [F.min(F.col(f"sum_{i}") - F.col(f"own_{i}")).alias(f"up_{i}") for i in range(PARTS)]
    nodes = materialize(chained.groupBy("depth", *sums).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), *before), "nodes")
    up = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(s).alias(f"up_{i}") for i, s in enumerate(sums)], F.col("conv_id").alias("parent"))
    # One row: the root's smallest member and how many there are.
    least, n = convs.agg(F.min("conv_id"), F.count("*")).first()
    level = F.lit(0).cast("long")
    top = turns.sparkSession.createDataFrame([(least, 0, None, n, 0)] if n else [], "conv_id long, depth long, parent_conv_id long, n_convs long, words long")
    # Parents of first turns are the root, which has no sums.
    first = nodes.where("depth = 1").withColumn("parent", F.lit(least).cast("long"))
    deeper = nodes.where("depth > 1").join(up, ["depth", *[f"up_{i}" for i in range(PARTS)]])
    columns = ["conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "words"]
    known = top.unionByName(first.select(*columns)).unionByName(deeper.select(*columns))
    last = chained.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = last.join(chained, ["conv_id", "depth"]).join(nodes.select("depth", *sums, F.col("conv_id").alias("node_conv")), ["depth", *sums]).select("conv_id", "node_conv", "depth")
    nowhere = convs.join(last, "conv_id", "left_anti").select("conv_id", F.lit(least).cast("long").alias("node_conv"), level.alias("depth"))
    return known, ends.unionByName(nowhere)


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, n_children, n_leaves, saved_tokens) for every node, by peeling runs. ``nodes`` is a written table."""
    hung = "depth > 0 and conv_id <> parent_conv_id"
    tops = nodes.where(hung).select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("conv_id").alias("run"))
    branches = tops.groupBy("conv_id", "depth").agg(F.count("*").alias("branches"))
    last = nodes.groupBy(F.col("conv_id").alias("run")).agg(F.max("depth").alias("end"))
    own = nodes.join(branches, ["conv_id", "depth"], "left").join(last, F.col("conv_id") == F.col("run"))
    children = F.coalesce("branches", F.lit(0)) + (F.col("depth") < F.col("end")).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("words")
    own = materialize(own.select("conv_id", "depth", children.alias("n_children"), (children == 0).cast("long").alias("leaf"), saved.alias("saved")), "own")
    # A run and its counter of runs that hang on it and have not sent their totals yet.
    above = nodes.where(hung).select("conv_id", F.col("parent_conv_id").alias("above"))
    waits = above.groupBy(F.col("above").alias("conv_id")).agg(F.count("*").alias("waits"))
    runs = own.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    runs = runs.join(above, "conv_id", "left").join(waits, "conv_id", "left").withColumn("waits", F.coalesce("waits", F.lit(0)).cast("long"))
    opened, done = materialize(runs.select("conv_id", "above", "waits", "leaves", "saved"), "runs"), []
    while True:
        done.append(materialize(opened.where("waits = 0").select("conv_id", "above", "leaves", "saved"), "done"))
        sent = done[-1].where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        left = opened.where("waits > 0").join(sent, "conv_id", "left").fillna(0, ["n", "more_leaves", "more_saved"])
        left = left.select("conv_id", "above", (F.col("waits") - F.col("n")).alias("waits"), (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"))
        nxt = materialize(left, "runs")
        drop_scratch(opened)
        opened = nxt
        if opened.isEmpty():
            break
    totals = done[0]
    for more in done[1:]:
        totals = totals.unionByName(more)
    arrived = tops.join(totals.select(F.col("conv_id").alias("run"), "leaves", "saved"), "run").groupBy("conv_id", "depth").agg(F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))
    rows = own.join(arrived, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "n_children", (-F.col("depth")).alias("up"),
        (F.col("leaf") + F.coalesce("in_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("in_saved", F.lit(0))).alias("saved"),
    )
    summed = running_totals(rows, ["conv_id"], ["up"], {"n_leaves": "leaves", "saved_tokens": "saved"})
    return summed.select("conv_id", "depth", "n_children", "n_leaves", "saved_tokens")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node_conv, depth, chunk, ids) in order; one SHA-256 a node, streamed."""
    now, state = None, None
    for batch in batches:
        out = []
        for node, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (node, depth) != now:
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (node, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _ended(out)
    if now:
        yield _ended([(*now, state.hexdigest())])


def _ended(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "depth", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes where conversations end.

    Ids are distinct, so a group of ``IDS`` neighbouring numbers is bounded;
    these texts, not the ids, meet in a node's task, which streams them.
    """
    chunks = ends.groupBy("node_conv", "depth", F.floor(F.col("conv_id") / IDS).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    dealt = chunks.select("node_conv", "depth", "chunk", "ids").repartition("node_conv", "depth").sortWithinPartitions("node_conv", "depth", "chunk")
    return dealt.mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node with its counts, subtree totals and digest of ends; ``turns`` (conv_id, depth, sha, words) are those of ``convs``."""
    known, ends = prefix_nodes(turns, convs)
    nodes = materialize(known, "trie")
    none = hashlib.sha256(b"").hexdigest()
    found = nodes.join(subtree_totals(nodes), ["conv_id", "depth"]).join(ends_digests(ends), ["conv_id", "depth"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
