"""SimHash against a plain double loop."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessella.llm import catalog, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows, most=3):
    """rows: (doc_id, fingerprint)."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= most:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(rows))]


def test_fingerprint(docs):
    texts = [r.text for r in docs.collect()] + ["a b c d " * 40_000]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_documents(spark, docs, no_docs):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(F.col("bits")), "component_id").collect()
    want = [(d, f"{b:016x}", c) for (d, b), c in zip(rows, brute_components(rows))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_op2(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (f"{b:016x}", c) for (d, b), c in zip(rows, brute_components(rows))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.op2_simhash(spark, sf).collect()} == want
    assert len({c for _, c in want.values()}) < len(want)


def linked(spark, values, file_rows):
    nodes = spark.createDataFrame([(i, simhash._signed(v)) for i, v in enumerate(values)], "node long, bits long")
    up = {i: i for i in range(len(values))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = simhash.near_links(nodes, 3, file_rows).collect()
    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(len(values))], len(links)


def test_links_chain_dense_balls_and_split_files(spark):
    """A ball of near fingerprints, chains at exactly 3 bits, pairs at exactly 4, and noise; files whole and split."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 400:
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    walk = rng.getrandbits(64)
    for step in range(60):
        walk ^= sum(1 << b for b in rng.sample(range(64), 3 + (step % 7 == 0)))
        values.add(walk)
    values |= {rng.getrandbits(64) for _ in range(300)}
    values = sorted(values)
    want = brute_components(list(enumerate(values)))
    for file_rows in (simhash.FILE_ROWS, 60):
        got, n = linked(spark, values, file_rows)
        assert got == want
        assert n < 400 * 400 // 4  # never all pairs of the ball


def test_pivots_discard_only_pairs_out_of_range():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 8, 2000)], dtype=np.uint64)
    bits = np.concatenate([a, a ^ flips])
    table = np.bitwise_count(bits[:, None] ^ simhash.pivots()[None, :]).astype(np.int8)
    i = np.arange(2000)
    left, _ = simhash._survivors(bits, table, i, i + 2000, 3)
    assert left.tolist() == np.flatnonzero(np.bitwise_count(flips) <= 3).tolist()


def test_rows_without_ids_join_only_what_they_are_near(spark):
    """Two rows without an id, near to two texts that are far from each other: they join nothing else."""
    rng = random.Random(8)
    one, two = ([f"w{rng.randrange(10**6)}" for _ in range(400)] for _ in range(2))
    other = lambda words: " ".join([*words[:-1], "changed"])
    rows = [(1, " ".join(one)), (None, other(one)), (2, " ".join(two)), (None, other(two)), (None, "alone"), (None, "alone"), (-5, "")]
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    assert (prints[0][1] ^ prints[2][1]).bit_count() > 20 and all((prints[i][1] ^ prints[i + 1][1]).bit_count() <= 3 for i in (0, 2))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(zip([d for d, _ in rows], brute_components(prints)), key=repr)
