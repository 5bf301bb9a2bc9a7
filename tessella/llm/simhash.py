"""SimHash near-duplicates, found through tables of distances to pivots.

Fingerprint: A-Z are lower-cased, words are runs of characters other than
space and \\t to \\r, and every three words in a row (repeats included) are
hashed by XXH64, seed 42; a bit of the fingerprint is set where it is set in
more than half of the hashes. A text of fewer words is one shingle; a text
without words has the fingerprint zero.

Links: fingerprints that differ in at most ``max_bits`` bits. Equal
fingerprints are one node. To keep the search near-linear, the 64 bits are cut
into ``max_bits + 2`` blocks; fingerprints in range agree on at least two
whole blocks, so each is filed under every pair of its blocks. Within a file
the distances of every fingerprint to ``PIVOTS`` reference fingerprints are
tabulated. By the triangle inequality two fingerprints in range have distances
to each pivot that differ by at most ``max_bits``: pairs whose greatest
coordinate difference is larger are discarded, and the survivors are verified
on all 64 bits. A file passes on only a spanning forest of its links, never all
its pairs, and files beyond ``FILE_ROWS`` are searched as pairs of parts.

Defined cases: null texts count as empty; rows without an id take part but no
component is named after them (one of only such rows is null); repeated rows
are equal fingerprints; an empty table gives an empty table; long texts are
hashed whole, in runs of ``RUN`` shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import connected_components
from tessella.session import materialize

SHINGLE = 3
SEED = 42
PIVOTS = 32
RUN = 65_536
FILE_ROWS = 16_384
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one whole text, as an unsigned integer."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    begin, end = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    del words
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(begin), RUN):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[at : at + RUN], end[at : at + RUN])], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(begin), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "bits"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits): the fingerprint of every row as a signed long."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, bits long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(n)], dtype=np.uint64)


def _survivors(bits: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (a, b): discards by the greatest coordinate difference, then verifies."""
    for p in range(table.shape[1]):
        if not len(a):
            break
        near = np.abs(table[a, p] - table[b, p]) <= most
        a, b = a[near], b[near]
    near = np.bitwise_count(bits[a] ^ bits[b]) <= most
    return a[near], b[near]


def _forest(bits: np.ndarray, table: np.ndarray, most: int) -> np.ndarray:
    """For each fingerprint of a large file, the first of those it is linked with, directly or not."""
    order = np.argsort(table[:, 0], kind="stable")
    bits, table = bits[order], table[order]
    parent = np.arange(len(bits))

    def roots(at: np.ndarray) -> np.ndarray:
        while True:
            above = parent[at]
            if (above == at).all():
                return at
            at = above

    reach = np.searchsorted(table[:, 0], table[:, 0] + most, side="right")
    for i in range(len(bits) - 1):
        near = np.arange(i + 1, reach[i])
        if not len(near):
            continue
        _, near = _survivors(bits, table, np.full(len(near), i), near, most)
        if len(near):
            near = np.append(near, i)
            tops = roots(near)
            parent[tops] = parent[near] = tops.min()
    out = np.empty(len(bits), dtype=np.int64)
    out[order] = order[roots(np.arange(len(bits)))]
    return out


def _linker(most: int, small: int = 64):
    """Reads rows (file, node, bits) sorted by file; yields links (src, dst) between nodes."""

    def link(file: np.ndarray, node: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = np.bitwise_count(bits[:, None] ^ pivots()[None, :]).astype(np.int8)
        bounds = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1], [True])))
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        src, dst = [], []
        for step in range(1, min(small, sizes.max()) if len(sizes) else 0):
            a = np.flatnonzero((group[step:] == group[:-step]) & (sizes[group[:-step]] <= small))
            a, b = _survivors(bits, table, a, a + step, most)
            src.append(node[a])
            dst.append(node[b])
        for k in np.flatnonzero(sizes > small):
            part = slice(bounds[k], bounds[k + 1])
            root = _forest(bits[part], table[part], most)
            own = np.flatnonzero(root != np.arange(len(root)))
            src.append(node[part][own])
            dst.append(node[part][root[own]])
        none = np.empty(0, dtype=np.int64)
        return np.concatenate([none, *src]), np.concatenate([none, *dst])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            rows += batch.num_rows
            if rows < 50_000:
                continue
            file, node, bits = (np.concatenate(x) for x in zip(*held))
            cut = int(np.flatnonzero(file != file[-1])[-1]) + 1 if file[0] != file[-1] else 0
            if cut:
                yield emit(file[:cut], node[:cut], bits[:cut])
            held, rows = [(file[cut:], node[cut:], bits[cut:])], len(file) - cut
        if held:
            yield emit(*(np.concatenate(x) for x in zip(*held)))

    def emit(file, node, bits) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in link(file, node, bits.view(np.uint64))], names=["src", "dst"])

    return run


def block_masks(blocks: int) -> list[int]:
    """Masks of the 64 bits cut into ``blocks`` runs, as even as can be."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(nodes: DataFrame, max_bits: int = 3, file_rows: int = FILE_ROWS) -> DataFrame:
    """(src, dst): links that join exactly the nodes (node, bits; distinct bits) that chains of near fingerprints join."""
    masks = [a | b for a, b in combinations(block_masks(max_bits + 2), 2)]
    # xxhash64 of (pair of blocks, their bits) names a file. Should two files share a name, they are merely searched together.
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("bits").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    filed = nodes.select("node", "bits", F.explode(keys).alias("file"))
    large = filed.groupBy("file").count().where(F.col("count") > file_rows).select("file", F.ceil(F.col("count") / file_rows).cast("int").alias("parts"))
    dealt = filed.join(materialize(large, "large"), "file", "left")
    # Part i of m meets every other part: in file (i, j) for j > i and (j, i) for j < i.
    part = F.pmod(F.xxhash64("bits", F.lit(7)), F.col("parts")).cast("int")
    meets = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("part")), lambda j: F.xxhash64("file", F.least(j, F.col("part")), F.greatest(j, F.col("part"))))
    dealt = dealt.withColumn("part", part).withColumn("file", F.explode(F.when(F.col("parts").isNull(), F.array("file")).otherwise(meets)))
    spread = dealt.select("file", "node", "bits").repartition("file").sortWithinPartitions("file")
    return spread.mapInArrow(_linker(max_bits), "src long, dst long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = 3) -> DataFrame:
    """(doc_id, bits, component_id) for every row: the smallest id that links reach, itself included."""
    own = materialize(fingerprints(docs, key, text), "fingerprints")
    # A fingerprint is its own node; the least id goes with it, null where only rows without one have it.
    nodes = materialize(own.groupBy("bits").agg(F.min("doc_id").alias("first")), "nodes")
    parts = connected_components(near_links(nodes.select(F.col("bits").alias("node"), "bits"), max_bits))
    part = nodes.join(parts, F.col("bits") == F.col("node"), "left").select("bits", "first", F.coalesce("component", "bits").alias("component"))
    named = part.join(part.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("bits", "component_id")
    # A fingerprint may have a third of all rows: an equi-join with one row a fingerprint, split where it is hot.
    return own.join(named, "bits").select("doc_id", "bits", "component_id")


def hex_digits(bits):
    """16 lower-case hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
