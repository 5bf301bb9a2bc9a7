"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves a bounded sample of ``SAMPLE`` vectors again and again, at
the median of their projections on a random direction (the one of ``TRIES``
that spreads them most), down to leaves of about ``LEAF``. All vectors are
filed under their leaf of every tree. A query walks all trees at once through
one shared priority queue: the open branch whose split planes it came nearest
to crossing is searched next, whichever tree it is in, until ``PROBES`` leaves
are found. A leaf's candidates meet all queries that probe it in one task (or
several, where a leaf outgrows ``PART``), which ranks them by exact distance,
in double precision, and passes on each query's best.

Equal vectors are one entry with its ``k + 1`` smallest ids: no more of them
can be among a query's k nearest, so a vector that a third of all rows share
makes no large leaf and no large answer, and nothing is lost.

Trees are as deep as the counted table needs for leaves of about ``LEAF``.
They are fitted on a sample (1 vector in 64, at least ``SAMPLE`` and at most
``MOST_SAMPLE``), whose nodes keep ``LEAST_NODE`` sampled vectors at least; a
table so large that this ends the trees early has larger leaves, which tasks
deal out in parts, vectors and queries alike. Below the first ``OWN_LEVELS``
levels all nodes of one level share a direction and differ in their middle, so
that the forest stays small on every worker.

``PROBES`` is not fixed: ``JUDGES`` queries are answered exactly, in one pass
over the table, and the least number of leaves that would have shown ``RECALL``
of their true neighbours is taken. Clustered vectors do with a few leaves;
vectors without structure (independent directions in 64 dimensions) take some
two fifths of any table, and no forest can do with less.

Defined cases: null vectors, zero vectors, and those with a null, NaN or
infinite component take no part, nor do those of another length than the most
frequent; queries without other candidates give no rows; ties go to the
smaller id; rows that repeat an id are one entry each, and the id is named
once, at its least distance; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize

SAMPLE, MOST_SAMPLE = 65_536, 524_288
#: Bytes of sampled vectors that may come to the driver.
MOST_BYTES = 268_435_456
LEAF = 512
LEAST_NODE = 8
TREES = 16
TRIES = 4
OWN_LEVELS = 10
JUDGES = 64
RECALL = 0.94
#: Vectors, and queries, of one leaf that meet in one task; larger leaves are dealt out.
PART = 50_000


class Forest:
    """Trees of equal depth: node i has the children 2i + 1 and 2i + 2; leaves are numbered from the left."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7, rows: int | None = None):
        rng = np.random.default_rng(seed)
        n, self.dim = sample.shape
        wanted, held = (int(np.ceil(np.log2(max(1, x)))) for x in ((n if rows is None else rows) / leaf, n / LEAST_NODE))
        self.depth = max(0, min(wanted, held))
        inner, own = (1 << self.depth) - 1, (1 << min(self.depth, OWN_LEVELS)) - 1
        self.normal = np.zeros((trees, own + self.depth, self.dim), dtype=np.float32)  # one for each upper node, then one for each level
        self.middle = np.zeros((trees, inner), dtype=np.float32)
        self.plane = np.concatenate([np.arange(own), own + np.floor(np.log2(np.arange(own, inner) + 1)).astype(np.int64)]).astype(np.int64)
        for t in range(trees):
            shared = rng.standard_normal((self.depth, self.dim)).astype(np.float32)
            self.normal[t, own:] = shared / np.linalg.norm(shared, axis=1, keepdims=True)
            self._grow(t, 0, np.arange(n), sample, rng)

    def _grow(self, tree: int, node: int, rows: np.ndarray, sample: np.ndarray, rng: np.random.Generator) -> None:
        if node >= self.middle.shape[1]:
            return
        plane = self.plane[node]
        if plane == node:
            tries = rng.standard_normal((TRIES, self.dim)).astype(np.float32)
            tries /= np.linalg.norm(tries, axis=1, keepdims=True)
            self.normal[tree, node] = tries[int(np.argmax((sample[rows] @ tries.T).std(axis=0))) if len(rows) else 0]
        place = sample[rows] @ self.normal[tree, plane]
        self.middle[tree, node] = np.median(place) if len(rows) else 0.0
        right = place > self.middle[tree, node]
        self._grow(tree, 2 * node + 1, rows[~right], sample, rng)
        self._grow(tree, 2 * node + 2, rows[right], sample, rng)

    def state(self) -> tuple:
        """What a broadcast carries: arrays and numbers, as workers have no copy of this class."""
        return self.dim, self.depth, self.normal, self.middle, self.plane

    @classmethod
    def of(cls, state: tuple) -> "Forest":
        forest = cls.__new__(cls)
        forest.dim, forest.depth, forest.normal, forest.middle, forest.plane = state
        return forest

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """(trees, rows): each vector's leaf in each tree."""
        out = np.zeros((len(self.middle), len(vectors)), dtype=np.int64)
        for t in range(len(self.middle)):
            node = np.zeros(len(vectors), dtype=np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", vectors, self.normal[t, self.plane[node]]) > self.middle[t, node]
                node = 2 * node + 1 + side
            out[t] = node - self.middle.shape[1]
        return out

    def walk(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf), nearest first, through one queue for all trees."""
        inner = self.middle.shape[1]
        place = self.normal @ query
        queue = [(0.0, t, 0) for t in range(len(self.middle))]
        while queue:
            cost, tree, node = heapq.heappop(queue)
            while node < inner:
                m = float(place[tree, self.plane[node]] - self.middle[tree, node])
                near, far = (2, 1) if m > 0 else (1, 2)
                heapq.heappush(queue, (max(cost, abs(m)), tree, 2 * node + far))
                node = 2 * node + near
            yield tree, node - inner

    def probe(self, query: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The first ``probes`` leaves to search."""
        return list(itertools.islice(self.walk(query), probes))

    def reach(self, query: np.ndarray, targets: np.ndarray) -> list[int]:
        """For each target, the number of leaves that a query's walk takes until it meets it."""
        open_ = {}
        for i, homes in enumerate(self.leaves(targets.astype(np.float32)).T):
            for home in enumerate(homes.tolist()):
                open_.setdefault(home, []).append(i)
        met: dict[int, int] = {}
        for n, home in enumerate(self.walk(query.astype(np.float32)), 1):
            for i in open_.get(home, ()):
                met.setdefault(i, n)
            if len(met) == len(targets):
                break
        return list(met.values())


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _filer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest.of(shared.value)
        for batch in batches:
            vectors = _matrix(batch.column(1), forest.dim).astype(np.float32)
            for tree, leaves in enumerate(forest.leaves(vectors)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaves), tree, dtype=np.int32)), pa.array(leaves), *batch.columns], names=["tree", "leaf", *batch.schema.names])

    return run


def _prober(shared, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest.of(shared.value)
        for batch in batches:
            vectors = _matrix(batch.column(1), forest.dim).astype(np.float32)
            found = [(i, t, leaf) for i, q in enumerate(vectors) for t, leaf in forest.probe(q, probes)]
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64()), *(c.take(at) for c in batch.columns)], names=["tree", "leaf", *batch.schema.names])

    return run


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>): the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, queries by vectors."""
    out = np.empty((len(queries), len(vectors)))
    for i, q in enumerate(queries):
        out[i] = np.sqrt(((vectors - q) ** 2).sum(axis=1))
    return out


def _ranker(dim: int, k: int):
    """Ranks one leaf (or part) for the queries that probe it."""

    def run(leaf: pa.Table, probes: pa.Table) -> pa.Table:
        own, asked = leaf.column("entry").to_numpy(), probes.column("q").to_numpy()
        if not len(own) or not len(asked):
            return pa.table({"q": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = leaf.column("ids").combine_chunks()
        order = np.argsort(pc.list_element(ids, 0).to_numpy(), kind="stable")  # so that a stable sort by distance leaves ties to the smaller id
        own, vectors, ids = own[order], _matrix(leaf.column("v").combine_chunks(), dim).astype(float)[order], ids.take(pa.array(order))
        flat = ids.flatten().to_numpy()
        single = len(flat) == len(own) and len(np.unique(flat)) == len(own)
        named = None if single else ids.to_pylist()
        queries = _matrix(probes.column("qv").combine_chunks(), dim).astype(float)
        q, entry, score = [], [], []
        for at in range(0, len(asked), 64):
            found = distances(queries[at : at + 64], vectors)
            best = np.argsort(found, axis=1, kind="stable")
            for i, near in enumerate(best):
                near = near[: k + 1] if single else near[_new_names(near, named, k + 1)]
                q.append(np.full(len(near), asked[at + i]))
                entry.append(own[near])
                score.append(found[i, near])
        return pa.table({"q": np.concatenate(q), "entry": np.concatenate(entry), "score": np.concatenate(score)})

    return run


def _new_names(near: np.ndarray, named: list[list[int]], most: int) -> list[int]:
    """Which entries, nearest first, bring an id that no nearer one has, until ``most`` ids are met."""
    met: set[int] = set()
    kept = []
    for place, entry in enumerate(near.tolist()):
        if len(met) >= most:
            break
        if not met.issuperset(named[entry]):
            met.update(named[entry])
            kept.append(place)
    return kept


def _judge(shared, k: int):
    """Each judge's k nearest of a partition, by distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = [(np.empty(0), np.empty(0, dtype=np.int64), np.empty((0, queries.shape[1])))] * len(ids)
        for batch in batches:
            own, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1), queries.shape[1]).astype(float)
            for i, found in enumerate(distances(queries, vectors)):
                other = own != ids[i]
                score, entry, v = (np.concatenate([x, y[other]]) for x, y in zip(best[i], (found, own, vectors)))
                first = np.argsort(score, kind="stable")[:k]
                best[i] = score[first], entry[first], v[first]
        for i, (score, _, v) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i)), pa.array(score), pa.array(list(v), pa.list_(pa.float64()))], names=["judge", "score", "v"])

    return run


def calibrated(forest: Forest, entries: DataFrame, asked: DataFrame, k: int, judges: int = JUDGES, recall: float = RECALL) -> int:
    """The least number of leaves that shows ``recall`` of the true neighbours of ``judges`` queries."""
    spark = entries.sparkSession
    picked = asked.dropDuplicates(["entry"]).orderBy(F.xxhash64("v"), "v").limit(judges).select("entry", "v").toArrow()
    if not picked.num_rows:
        return 1
    queries = _matrix(picked.column("v").combine_chunks(), forest.dim).astype(float)
    shared = spark.sparkContext.broadcast((picked.column("entry").to_numpy(), queries))
    near = entries.select("entry", "v").mapInArrow(_judge(shared, k), "judge long, score double, v array<double>")
    near = near.withColumn("r", F.expr("row_number() over (partition by judge order by score)")).where(F.col("r") <= k).select("judge", "v").collect()
    reach = []
    for i, q in enumerate(queries):
        own = np.array([r.v for r in near if r.judge == i])
        reach += forest.reach(q, own) if len(own) else []
    return int(np.sort(reach)[int(np.ceil(recall * len(reach))) - 1]) if reach else 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, probes: int | None = None, part: int = PART) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``is_query`` (over the column ``id``) picks, its k nearest others."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes.n if sizes else 1
    rows = rows.where(F.size("v") == dim)
    # The rank by vector keeps k + 1 rows of each before it shuffles them.
    least = rows.distinct().withColumn("r", F.expr("row_number() over (partition by v order by id)")).where(F.col("r") <= k + 1)
    entries = materialize(least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("entry"), "v", "ids"), "entries")
    n = entries.count()
    taken = entries.orderBy(F.xxhash64("v"), "v").limit(min(max(sample, min(n // 64, MOST_SAMPLE)), MOST_BYTES // (8 * dim))).select("v").toArrow().column("v").combine_chunks()
    forest = Forest(_matrix(taken, dim).astype(np.float32) if len(taken) else np.zeros((0, dim), dtype=np.float32), trees, leaf, rows=n)
    shared = spark.sparkContext.broadcast(forest.state())
    asked = materialize(rows.where(is_query).distinct().join(entries.select("entry", "v"), "v").select("id", "entry", "v"), "asked")
    probes = calibrated(forest, entries, asked, k) if probes is None else probes
    filed = entries.select("entry", "v", "ids").mapInArrow(_filer(shared), "tree int, leaf long, entry long, v array<double>, ids array<long>")
    queries = asked.select(F.col("entry").alias("q"), F.col("v").alias("qv")).dropDuplicates(["q"])
    probed = materialize(queries.mapInArrow(_prober(shared, probes), "tree int, leaf long, q long, qv array<double>"), "probed")
    # One row for each leaf of the forest that outgrows a task: fewer than the forest, which every worker holds anyway.
    over = lambda rows, name: rows.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / part).cast("int").alias(name))
    large = F.broadcast(materialize(over(filed, "parts").join(over(probed, "asks"), ["tree", "leaf"]).where("parts > 1 or asks > 1"), "large"))
    each = lambda of: F.explode(F.sequence(F.lit(0), F.coalesce(of, F.lit(1)) - 1))
    mine = lambda key, of: F.pmod(F.xxhash64(key), F.coalesce(of, F.lit(1))).cast("int")
    # Every part of a leaf's vectors meets every part of its queries.
    filed = filed.join(large, ["tree", "leaf"], "left").withColumn("part", mine("entry", "parts")).withColumn("ask", each("asks")).drop("parts", "asks")
    probed = probed.join(large, ["tree", "leaf"], "left").withColumn("ask", mine("q", "asks")).withColumn("part", each("parts")).drop("parts", "asks")
    by = ["tree", "leaf", "part", "ask"]
    pairs = filed.groupBy(*by).cogroup(probed.groupBy(*by)).applyInArrow(_ranker(dim, k), "q long, entry long, score double")
    pairs = pairs.groupBy("q", "entry").agg(F.min("score").alias("score"))
    named = pairs.join(entries.select("entry", "ids"), "entry").select("q", "score", F.explode("ids").alias("id"))
    named = named.groupBy("q", "id").agg(F.min("score").alias("score")).withColumn("r", F.expr("row_number() over (partition by q order by score, id)")).where(F.col("r") <= k + 1)
    answers = asked.select(F.col("id").alias("query_id"), F.col("entry").alias("q")).join(named.select("q", "id", "score"), "q").where("id <> query_id")
    answers = answers.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    ranked = answers.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, id)")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
