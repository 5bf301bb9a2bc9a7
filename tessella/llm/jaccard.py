"""Links and components of documents by the Jaccard similarity of their word shingles.

A-Z are lower-cased, words are runs of characters other than space and \\t to
\\r, a document's set is that of its distinct shingles of ``SIZE`` words (a
shorter text is one shingle of all its words). Two documents link when their
sets share ``PERCENT`` hundredths of their union or more.

Index: a set's shingles are hashed into ``GROUPS`` groups; the counts by group
are a point, and points are held in an R-tree (leaves of ``LEAF`` points, boxes
that keep the greatest coordinates and the range of sizes). Two sets share at
most the sum of the smaller of their coordinates, and two boxes at most the sum
over their corners, so pairs of boxes below the needed overlap are discarded
with all they hold; surviving pairs of points are verified on whole texts.

What meets in one tree: linked sets must agree on one of their rarest
``n - ceil(0.85 n) + 1`` shingles, so each set is filed under these (no link is
lost). Rarity is a count by hash bucket over all documents; only the order
depends on it, not what is found. Files with the same members are one file.

Rounds. First every set looks only into its largest file and names two partners:
the first in a fixed order and the nearest. The verified ones make components,
which fold a family of near copies of any size without naming all its pairs.
Then files that still hold several components are searched in whole for pairs
between different ones; a file passes on only a spanning forest of these, and
the sets that forests join are a cluster. A cluster's whole texts meet, where
every pair between components that the tree leaves is counted exactly, and again
a forest of the true links is passed on; after that no link can be missing from
the components. A file or cluster above its limit is dealt into parts: first
with some leaders in every part; afterwards the rows of its commonest component
need not meet each other, and the other rows meet every part.

Defined cases: null texts are empty; sets without shingles link with nothing,
each row with its own id; equal sets are one node, so copies make no pairs; rows
without an id take part but no component is named after them (one of only such
rows is null); rows that repeat an id are rows of their own; other columns are
ignored; an empty table gives no rows; texts are hashed whole. Shingles are told
apart by 64 bits, sets by 128.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import connected_components
from tessella.session import broadcast_small, materialize

SIZE = 4
PERCENT = 85
GROUPS = 128
LEAF = 32
FAN = 8
FILE_ROWS = 2_048
#: Texts of a cluster that meet in one task.
CLUSTER_ROWS = 512
#: Bytes of a cluster's sets as bits; beyond, pairs are counted one by one.
BIT_BYTES = 64_000_000
LEADERS = 32
#: Members of one leader that are verified in one task.
STAR = 256
BUCKET_BITS = 18
WORDS_HELD = 150_000
#: Texts of one Arrow batch that are described before they are handed on.
PIECE = 1_000
RUN = 1_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Words(dict):
    """Hashes of words, computed once as long as they are held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, size: int = SIZE, held: dict | None = None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map((_Words() if held is None else held).__getitem__, words), dtype=np.uint64, count=len(words))
    length = min(size, len(words))
    ends = len(words) - length + 1
    found = np.full(ends, length, dtype=np.uint64)
    for i in range(length):
        found = _mix(found * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + ends])
    return np.unique(found)


def needed(n: int, percent: int = PERCENT) -> int:
    """How many shingles of a set of n any linked set must share."""
    return -(-percent * n // 100)


def linked(shared: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[bytes | None]:
    return (t.as_py() for t in batch.column(at).cast(pa.binary()))


def rarity(docs: DataFrame, size: int = SIZE) -> np.ndarray:
    """How many documents' shingles fall in each hash bucket: a table of fixed size, merged on executors two by two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, seen, kept = np.zeros(1 << BUCKET_BITS, dtype=np.int64), _Words(), [], 0
        for batch in batches:
            for text in _texts(batch, 0):
                seen.append(shingles(text, size, held) >> np.uint64(64 - BUCKET_BITS))
                kept += len(seen[-1])
                if kept > RUN:
                    total += np.bincount(np.concatenate(seen).view(np.int64), minlength=len(total))
                    seen, kept = [], 0
        if seen:
            total += np.bincount(np.concatenate(seen).view(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    parts = docs.select("text").mapInArrow(count, "part binary").rdd.map(lambda r: pickle.loads(r.part))
    return parts.treeReduce(lambda a, b: a + b) if parts.getNumPartitions() else np.zeros(1 << BUCKET_BITS, dtype=np.int64)


def _sha():
    """What a text is read again by."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def described(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(row, doc_id, sha, n, digest, point, keys) for every row: size and digest of its set, counts by group, and the hashes of its rarest shingles."""
    counts = docs.sparkSession.sparkContext.broadcast(rarity(docs, size))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = _Words(), counts.value
        for batch in (whole.slice(at, PIECE) for whole in batches for at in range(0, whole.num_rows, PIECE)):
            sizes, digests, points, keys = [], [], [], []
            for text in _texts(batch, 2):
                found = shingles(text, size, held)
                n = len(found)
                order = np.lexsort((found, table[(found >> np.uint64(64 - BUCKET_BITS)).view(np.int64)]))
                sizes.append(n)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                points.append(np.bincount((found % np.uint64(GROUPS)).view(np.int64), minlength=GROUPS).astype("<u4").tobytes())
                keys.append(found[order[: n - needed(n, percent) + 1 if n else 0]].view(np.int64))
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *keys])))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(points, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sha", "n", "digest", "point", "keys"])

    read = docs.select("doc_id", _sha().alias("sha"), "text")
    found = read.mapInArrow(describe, "doc_id long, sha binary, n long, digest binary, point binary, keys array<long>")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "sets")


def filed(nodes: DataFrame) -> DataFrame:
    """(file, node): the sets that agree on a rare shingle, under the hash of their members; sets alone in their file are left out."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    # Files of the same members get the same name. Should others share it, they are merely searched together.
    several = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("members")).where("rows > 1")
    return keyed.join(several.select("key", F.xxhash64("members", "rows").alias("file")), "key").select("file", "node").distinct()


def _enough(shared, a, b, percent: int):
    """The test of links, as ``shared`` of two sets of a and b."""
    return (100 + percent) * shared >= percent * (a + b)


def _boxes(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, cuts: np.ndarray):
    at = cuts[:-1]
    return (np.maximum.reduceat(points, at), *(f.reduceat(x, at) for x in (sizes, labels) for f in (np.minimum, np.maximum)))


def tree_pairs(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bound): the pairs of points of different labels that may link, from an R-tree met with itself.

    The points are packed by size, and within a slab of sizes by their greatest
    coordinate's group; a pair of boxes is discarded when its sizes, its corners
    or its labels (one label throughout both) rule out links.
    """
    slab = max(LEAF, int(np.sqrt(len(points) * LEAF)))
    by_size = np.argsort(sizes, kind="stable")
    order = by_size[np.lexsort((points[by_size].argmax(axis=1), np.arange(len(points)) // slab))]
    points, sizes, labels = points[order].astype(np.int64), sizes[order].astype(np.int64), labels[order]
    levels = [_boxes(points, sizes, labels, np.append(np.arange(0, len(points), LEAF), len(points)))]
    while len(levels[-1][0]) > FAN:
        high, low_n, high_n, low_l, high_l = levels[-1]
        at = np.arange(0, len(high), FAN)
        levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at), np.minimum.reduceat(low_l, at), np.maximum.reduceat(high_l, at)))
    a, b = np.triu_indices(len(levels[-1][0]))
    for depth in range(len(levels) - 1, -1, -1):
        high, low_n, high_n, low_l, high_l = levels[depth]
        keep = (100 * high_n[a] >= percent * low_n[b]) & (100 * high_n[b] >= percent * low_n[a])
        keep &= ~((low_l[a] == high_l[a]) & (low_l[b] == high_l[b]) & (low_l[a] == low_l[b]))
        a, b = a[keep], b[keep]
        bound = np.concatenate([np.minimum(high[a[s : s + 1_024]], high[b[s : s + 1_024]]).sum(axis=1) for s in range(0, len(a), 1_024)] or [np.empty(0, dtype=np.int64)])
        keep = _enough(bound, low_n[a], low_n[b], percent)
        a, b = a[keep], b[keep]
        if depth:
            below = len(levels[depth - 1][0])
            step = np.arange(FAN)
            a, b = (np.repeat(a, FAN * FAN) * FAN + np.tile(np.repeat(step, FAN), len(a)), np.repeat(b, FAN * FAN) * FAN + np.tile(np.tile(step, FAN), len(b)))
            inside = (a < below) & (b < below) & (a <= b)
            a, b = a[inside], b[inside]
    for x, y in zip(a.tolist(), b.tolist()):
        i, j = np.arange(x * LEAF, min(len(points), x * LEAF + LEAF)), np.arange(y * LEAF, min(len(points), y * LEAF + LEAF))
        shared = np.minimum(points[i][:, None, :], points[j][None, :, :]).sum(axis=2)
        may = _enough(shared, sizes[i][:, None], sizes[j][None, :], percent) & (labels[i][:, None] != labels[j][None, :])
        if x == y:
            may &= i[:, None] < j[None, :]
        p, q = np.nonzero(may)
        if len(p):
            yield order[i[p]], order[j[q]], shared[p, q]


def _partners(n: int, nodes: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For each point its first possible partner in a fixed order, if before itself, and its nearest."""
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(_mix(nodes.astype(np.uint64)), kind="stable")] = np.arange(n)
    first, nearest, most = rank.copy(), np.full(n, -1), np.full(n, -1)
    for i, j, shared in found:
        for p, q in ((i, j), (j, i)):
            np.minimum.at(first, p, rank[q])
            # The nearest: of the greatest bound, and of equal ones whichever comes last.
            best = np.lexsort((shared, p))
            last = best[np.append(p[best][1:] != p[best][:-1], True)]
            better = last[shared[last] > most[p[last]]]
            most[p[better]], nearest[p[better]] = shared[better], q[better]
    back = np.argsort(rank)
    own = np.arange(n)
    early, near = first < rank, nearest >= 0
    return np.concatenate([own[early], own[near]]), np.concatenate([back[first[early]], nearest[near]])


def _forest(labels: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (i, j), those that first join what labels and the pairs before them have left apart."""
    part = np.unique(labels, return_inverse=True)[1]
    a, b = [], []
    for i, j in found:
        while True:
            apart = np.flatnonzero(part[i] != part[j])
            if not len(apart):
                break
            i, j = i[apart], j[apart]
            a.append(i[0])
            b.append(j[0])
            part[part == part[j[0]]] = part[i[0]]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def counted(sets: list[np.ndarray], percent: int = PERCENT):
    """A function from pairs (i, j) of sets to those that link, by their exact overlap."""
    sizes = np.array([len(x) for x in sets])
    every, times = np.unique(np.concatenate(sets), return_counts=True)
    shared = every[times > 1]  # what only one set has is in no overlap
    if len(sets) * (len(shared) // 8 + 1) > BIT_BYTES:
        return lambda i, j: np.array([linked(len(np.intersect1d(sets[p], sets[q], assume_unique=True)), sizes[p], sizes[q], percent) for p, q in zip(i, j)], dtype=bool)
    bits = np.zeros((len(sets), len(shared) // 8 + 1), dtype=np.uint8)
    for k, own in enumerate(sets):
        row = np.zeros(bits.shape[1] * 8, dtype=bool)
        row[np.searchsorted(shared, own[np.isin(own, shared, assume_unique=True)])] = True
        bits[k] = np.packbits(row)

    def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.concatenate([_enough(np.bitwise_count(bits[i[s : s + 256]] & bits[j[s : s + 256]]).sum(axis=1, dtype=np.int64), sizes[i[s : s + 256]], sizes[j[s : s + 256]], percent) for s in range(0, len(i), 256)])

    return test


def _searcher(of: str, size: int, percent: int):
    """Reads rows (file, node, label, n, point) or (file, node, label, text) sorted by file; yields pairs (a, b) of nodes.

    ``partners``: each node's two; ``forest``: what joins labels by pairs that
    may link; ``links``: what joins them by pairs that do.
    """

    def search(rows: pa.Table, held: dict) -> tuple[np.ndarray, np.ndarray]:
        node, label = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        if of == "links":
            sets = [shingles(t.as_py(), size, held) for t in rows.column(3)]
            sizes = np.array([len(x) for x in sets])
            points = np.array([np.bincount((x % np.uint64(GROUPS)).view(np.int64), minlength=GROUPS) for x in sets])
            test = counted(sets, percent)
            pairs = ((i[hit], j[hit]) for i, j, _ in tree_pairs(points, sizes, label, percent) if (hit := test(i, j)).any())
            i, j = _forest(label, pairs)
        else:
            points = np.frombuffer(b"".join(rows.column(4).to_pylist()), dtype="<u4").reshape(-1, GROUPS)
            found = tree_pairs(points, rows.column(3).to_numpy(), label, percent)
            i, j = _partners(len(node), node, found) if of == "partners" else _forest(label, ((i, j) for i, j, _ in found))
        return np.minimum(node[i], node[j]), np.maximum(node[i], node[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], _Words()
        for batch in batches:
            if not batch.num_rows:
                continue
            files = batch.column(0).to_numpy()
            last = int(np.flatnonzero(files == files[-1])[0])
            if last or (held and held[-1].column(0)[-1].as_py() != files[0]):
                yield emit(pa.Table.from_batches([*held, batch.slice(0, last)]), words)
                held = []
            held.append(batch.slice(last))
        if held:
            yield emit(pa.Table.from_batches(held), words)

    def emit(rows: pa.Table, words: dict) -> pa.RecordBatch:
        file = rows.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1], [True]))).tolist() if len(file) else []
        found = [search(rows.slice(s, e - s), words) for s, e in zip(cuts, cuts[1:]) if e - s > 1]
        a, b = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (zip(*found) if found else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _searched(rows: DataFrame, of: str, size: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, from rows (file, node, label, ...)."""
    return rows.repartition("file").sortWithinPartitions("file").mapInArrow(_searcher(of, size, percent), "a long, b long").where("a < b").distinct()


def _pointed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (file, node, label) with their sizes and points."""
    return rows.join(nodes.select("node", "n", "point"), "node").select("file", "node", "label", "n", "point")


def first_pairs(files: DataFrame, nodes: DataFrame, file_rows: int = FILE_ROWS, percent: int = PERCENT) -> DataFrame:
    """Two partners at most for every set, from its largest file."""
    sizes = files.groupBy("file").agg(F.count("*").alias("rows"))
    own = files.join(sizes, "file").groupBy("node").agg(F.max(F.struct("rows", "file")).alias("most")).select("node", F.col("most.file").alias("file"))
    own = materialize(own, "largest")
    large = own.groupBy("file").count().where(F.col("count") > file_rows).select("file", F.col("count").alias("rows"), F.ceil(F.col("count") / file_rows).cast("int").alias("parts"))
    dealt = own.join(materialize(large, "large"), "file", "left")
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    leads = F.pmod(F.xxhash64("node"), F.col("rows")) < LEADERS
    parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(leads, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))
    spread = dealt.select(F.explode(parts).alias("part"), "file", "node").select(F.xxhash64("file", "part").alias("file"), "node", F.col("node").alias("label"))
    return _searched(_pointed(spread, nodes), "partners", SIZE, percent)


def mixed(files: DataFrame, labels: DataFrame) -> DataFrame:
    """(file, node, label, rows) of the files whose sets have several labels (node, label; a set without one is its own)."""
    known = files.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = known.groupBy("file").agg(F.count("*").alias("rows"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return materialize(known.join(several.select("file", "rows"), "file").select("file", "node", "label", "rows"), "mixed")


def dealt(rows: DataFrame, file_rows: int) -> DataFrame:
    """(file, node, label): files of at most ``file_rows`` rows, in which all rows of different labels of one file meet.

    In a large file the rows of its commonest label go to parts that do not
    meet each other; the others meet all parts.
    """
    small = rows.where(F.col("rows") <= file_rows).select("file", "node", "label")
    large = rows.where(F.col("rows") > file_rows)
    commonest = large.groupBy("file", "label").agg(F.count("*").alias("same"), F.first("rows").alias("rows")).groupBy("file").agg(F.max(F.struct("same", "label")).alias("most"), F.first("rows").alias("rows"))
    half = max(1, file_rows // 2)
    commonest = commonest.select("file", F.col("most.label").alias("main"), F.ceil(F.col("most.same") / half).cast("int").alias("mains"), F.ceil((F.col("rows") - F.col("most.same")) / half).cast("int").alias("others"))
    parts = large.select("file", "node", "label").join(materialize(commonest, "commonest"), "file")
    main = F.col("label") == F.col("main")
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.when(main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    parts = parts.withColumn("is_main", main).withColumn("part", part)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    others, mains = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(0), F.col("mains") - 1)
    meets = F.when(F.col("is_main"), F.transform(others, lambda j: pair(F.lit(-1) - F.col("part"), j))).otherwise(
        F.concat(F.transform(mains, lambda i: pair(F.lit(-1) - i, F.col("part"))), F.transform(others, lambda j: pair(F.least(j, F.col("part")), F.greatest(j, F.col("part")))))
    )
    spread = parts.select("file", "node", "label", F.explode(meets).alias("m")).select(F.xxhash64("file", "m.i", "m.j").alias("file"), "node", "label")
    return small.unionByName(spread)


def texts_of(named: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows that name nodes, with the texts of these, read again rather than kept; of documents that repeat id and text one.

    What is named goes to the texts (it is broadcast if counted to be few), so a
    text travels once, to where the row is wanted.
    """
    wanted = nodes.join(named, "node").select(*named.columns, "sha", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "times")
    read = docs.select(_sha().alias("sha"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text")
    found = read.join(broadcast_small(materialize(wanted, "named")), ["sha", "id", "no_id"])
    columns = [*named.columns, "text"]
    return found.where("times = 1").select(*columns).unionByName(found.where("times > 1").select(*columns).dropDuplicates(named.columns))


def _verifier(size: int, percent: int):
    """Reads rows (star, salt, member, node, text) sorted, a star's own text first; yields (a, b, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, own = _Words(), None, None
        for batch in batches:
            a, b, links = [], [], []
            star, _, member, node = (batch.column(i).to_pylist() for i in range(4))
            for s, m, n, text in zip(star, member, node, _texts(batch, 4)):
                found = shingles(text, size, held)
                if not m:
                    now, own = s, found
                    continue
                assert now == s, "a member without its star"
                shared = len(np.intersect1d(own, found, assume_unique=True))
                a.append(min(s, n))
                b.append(max(s, n))
                links.append(linked(shared, len(own), len(found), percent))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.bool_())], names=["a", "b", "links"])

    return run


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(a, b, links) for written pairs, by the whole texts of both.

    Pairs meet at the end that has more of them, ``STAR`` in a task at most, so
    a text travels once for each pair and once for each such star.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    ends = materialize(ends, "degrees")
    by = pairs.join(ends.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(ends.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    at_a = F.col("da") >= F.col("db")
    turned = by.select(F.when(at_a, F.col("a")).otherwise(F.col("b")).alias("star"), F.when(at_a, F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("da", "db").alias("degree"))
    turned = materialize(turned.select("star", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("degree") / STAR)).cast("int").alias("salt")), "stars")
    roles = turned.select("star", "salt", F.lit(1).alias("member"), "node").unionByName(turned.select("star", "salt", F.lit(0).alias("member"), F.col("star").alias("node")).distinct())
    rows = texts_of(roles, nodes, docs).select("star", "salt", "member", "node", "text")
    return rows.repartition("star", "salt").sortWithinPartitions("star", "salt", "member").mapInArrow(_verifier(size, percent), "a long, b long, links boolean").distinct()


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, file_rows: int = FILE_ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the size of its set, and the smallest id that links reach, itself included."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = described(docs, size, percent)
    heads = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("row").alias("node"), F.count("*").alias("copies"))
    heads = materialize(heads, "heads")
    copies = materialize(sets.where("n > 0").select("digest", F.col("row").alias("node")).join(heads.where("copies > 1").select("digest", F.col("node").alias("head")), "digest").where("node <> head").select("node"), "copies")
    repeated = materialize(sets.where("n > 0").groupBy("sha", "doc_id").agg(F.count("*").alias("times"), F.min("row").alias("node")).where("times > 1").select("node", "times"), "repeated")
    nodes = sets.where("n > 0").withColumnRenamed("row", "node").join(broadcast_small(copies), "node", "left_anti")
    nodes = nodes.join(broadcast_small(repeated), "node", "left").withColumn("times", F.coalesce("times", F.lit(1)))
    files = materialize(filed(nodes), "files")
    pairs = materialize(first_pairs(files, nodes, file_rows, percent), "pairs")
    judged = materialize(verified(pairs, nodes, docs, size, percent), "judged")
    links = judged.where("links").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = materialize(connected_components(links).withColumnRenamed("component", "label"), "labels")
    joins = _searched(_pointed(dealt(mixed(files, labels), file_rows), nodes), "forest", size, percent)
    known = labels.where("node <> label").select(F.col("node").alias("src"), F.col("label").alias("dst"))
    joins = materialize(joins.select(F.col("a").alias("src"), F.col("b").alias("dst")), "joins")
    clusters = materialize(connected_components(known.unionByName(joins)).select("node", F.col("component").alias("file")), "clusters")
    texts_met = texts_of(dealt(mixed(clusters, labels), min(file_rows, CLUSTER_ROWS)), nodes, docs).select("file", "node", "label", F.col("text").cast("binary").alias("text"))
    later = materialize(_searched(texts_met, "links", size, percent), "links").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    # Labels stand for the links that made them.
    found = connected_components(known.unionByName(later))
    part = heads.join(found.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = part.groupBy("label").agg(F.min("first").alias("component_id"))
    named = part.select("digest", "label").join(least, "label").select("digest", "component_id")
    # A set may have a third of all rows: an equi-join with one row a set, split where it is hot.
    out = sets.select("doc_id", "n", "digest").join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
