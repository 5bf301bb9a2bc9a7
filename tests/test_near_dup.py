"""Near-duplicate links, components and the greedy choice against brute force."""

import random

from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import dedup
from tessella.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def grams(k):
    return {k[i : i + 3] for i in range(len(k) - 2)} if len(k) >= 3 else {k}


def brute(keys):
    """(a, b) of all links at 0.93 or more between ids with a key."""
    sets = {i: grams(k) for i, k in keys.items() if k}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.93}


def families(seed, n=6):
    """Families of near copies around the threshold, of all sizes, with exact copies and short and empty keys."""
    rng, out = random.Random(seed), ["", "", "a", "a", "ab", "abc", "abcabc", "abcabcabc"]
    for f in range(n):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz0123456789中文") for _ in range(20 * 2**f)]
        for _ in range(9):
            own = base[:]
            for _ in range(rng.randint(0, 1 + len(own) // 70)):
                own[rng.randrange(len(own))] = rng.choice("0123456789")
            out.append("".join(own))
    rng.shuffle(out)
    return dict(enumerate(out))


def components(keys, links):
    up = {i: i for i in keys}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in keys}


def test_all_links_and_components(spark):
    for seed in (1,):
        keys = families(seed)
        want = brute(keys)
        rows = spark.createDataFrame(list(keys.items()), "id long, k string")
        nodes, members = dedup.distinct_keys(rows, "id", "k")
        got = {(r.a, r.b) for r in dedup.near_pairs(nodes).collect()}
        first = {}
        for i, k in keys.items():
            first.setdefault(k, i)
        assert got == {(a, b) for a, b in want if first[keys[a]] == a and first[keys[b]] == b}
        assert {(r.node, r.id) for r in members.collect()} == {(first[k], i) for i, k in keys.items() if k}
        assert {r.id: r.component for r in dedup.near_duplicate_components(rows, "id", "k").collect()} == components(keys, want)


def test_greedy_drops_like_the_sequential_choice(spark):
    rng = random.Random(3)
    links = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    kept = []
    for i in range(60):
        if not any((a, i) in links for a in kept):
            kept.append(i)
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r.id for r in dedup.greedy_dropped(frame).collect()} == set(range(60)) - set(kept)


def test_near_copies_are_found_in_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.regexp_replace(F.lower("text"), r"[^0-9a-z\x{3400}-\x{9fff}]", "").alias("k"))
    keys = {r.doc_id: r.k or "" for r in docs.collect()}
    links = brute(keys)
    kept = set()
    for i in sorted(keys):
        if not any((a, i) in links for a in kept):
            kept.add(i)
    assert {r.doc_id for r in QUERIES["greedy_near_dup_keep"](spark, SF).where("kept").collect()} == kept
    assert {r.doc_id: r.component for r in QUERIES["near_dup_components"](spark, SF).collect()} == components(keys, links)


def test_unlike_sets_that_share_a_part_are_no_candidates(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    keys = {i: "".join(rng.choice(words) for _ in range(120)) for i in range(150)}
    keys |= {1000 + i: keys[i] + "0" for i in range(5)}
    nodes, _ = dedup.distinct_keys(spark.createDataFrame(list(keys.items()), "id long, k string"), "id", "k")
    _, buckets = dedup._buckets(nodes, 0.93)
    found, want = {(r.a, r.b) for r in dedup._bucket_pairs(buckets, 0.93).collect()}, brute(keys)
    assert len(want) >= 5 and want <= found and len(found) <= 2 * len(want)


def test_a_key_is_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(text):
        calls.add(1)
        return text

    rows = spark.createDataFrame([(i, "abc"[i % 3] * (i % 7)) for i in range(200)], "id long, t string").repartition(4)
    nodes, members = dedup.distinct_keys(rows.select("id", key("t").alias("k")), "id", "k")
    assert (nodes.count(), members.count()) == (18, len([i for i in range(200) if i % 7]))
    assert calls.value == 200


def test_dedupe_key_keeps_runs_of_letters_digits_and_cjk(spark):
    texts = [None, "", " ", "A-b_C 1", "stra\u00dfe \ufb01x \u212a", "\u4e2d\u6587, \u3400\u9fff!", "\u00e9t\u00e9\n\U0001d400 x"]
    got = [r.k for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.dedupe_key(F.col("t")).alias("k")).orderBy("i").collect()]
    assert got == ["", "", "", "abc1", "strassefixk", "\u4e2d\u6587\u3400\u9fff", "tx"]
