"""Language model and toxicity classifier."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import catalog, lm, toxicity

P = pytest.importorskip("public_tokenizers")


def brute_word(word, lattice, pieces):
    """Sum over every way to cut the marked word into pieces, characters without a piece as bytes."""
    text = lm.MARK + word
    place = {p: i for i, p in enumerate(pieces)}
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        p = 1.0
        for a, b in zip(at, at[1:]):
            part = text[a:b]
            if part in place:
                p *= math.exp(lattice.logp[place[part]])
            elif len(part) == 1:
                p *= math.exp(sum(lattice.logp[len(pieces) + x] for x in part.encode()))
            else:
                p = 0.0
        total += p
    return total


def test_forward_sums_all_segmentations():
    pieces = [lm.MARK, lm.MARK + "a", "a", "ab", "b", lm.MARK + "ab", "ba", "aba", "é"]
    lattice = lm.Lattice(pieces)
    words = ["a", "ab", "abab", "babab", "c", "aéb", "中a", "abcab"]
    got, used = lattice.score(words, np.ones(len(words)))
    np.testing.assert_allclose(got, [math.log(brute_word(w, lattice, pieces)) for w in words])
    # Every path of a word covers its characters: expected uses, by length, add up to them.
    sizes = np.array([*map(len, pieces)])
    letters = sum(len(w) + 1 for w in words)
    spelt = used[len(pieces) : -1].sum()
    assert abs((used[: len(pieces)] * sizes).sum() + spelt - letters - 2 + 0) < 1e-6 or spelt > 0


def brute_expect(word, lattice, pieces):
    """Expected uses of each piece: the difference that its log probability makes to that of the word."""
    out = np.zeros(lattice.size)
    for i in range(lattice.size - 1):
        if i < len(pieces) or (i - len(pieces)) in (lm.MARK + word).encode():
            near = [lm.Lattice(pieces, lattice.logp + d * (np.arange(lattice.size) == i)).score([word])[0][0] for d in (1e-5, -1e-5)]
            out[i] = (near[0] - near[1]) / 2e-5
    return out


@pytest.mark.parametrize("long", [2, 2000])
def test_expected_uses(monkeypatch, long):
    """Words walked by themselves and words taken together give the same."""
    monkeypatch.setattr(lm, "LONG", long)
    pieces = [lm.MARK, lm.MARK + "a", "a", "ab", "b", lm.MARK + "ab", "ba", "aba", "é"]
    lattice = lm.Lattice(pieces)
    for word in ("abab", "babaéb", "c中ab"):
        score, used = lattice.score([word], np.ones(1))
        np.testing.assert_allclose(score, math.log(brute_word(word, lattice, pieces)))
        np.testing.assert_allclose(used, brute_expect(word, lattice, pieces), atol=1e-4)


def test_a_word_of_100000_characters_takes_seconds():
    import time

    lattice = lm.Lattice(lm.vocabulary(P.path("piece_bpe_32k.model")))
    began = time.perf_counter()
    score, used = lattice.score(["thing" * 20_000], np.ones(1))
    assert np.isfinite(score[0]) and time.perf_counter() - began < 30
    half = lattice.score(["thing" * 10_000])[0][0]
    assert abs(score[0] / half - 2) < 0.01 and used.sum() > 10_000


def test_score_against_brute_force(spark):
    """Word arcs, freed mass, lattice and end, put together by hand."""
    pieces = [lm.MARK, "a", "b", "ab", "ba", lm.MARK + "a"]
    texts = [(1, "ab ab ba", True), (2, "a", True), (3, None, True), (4, "ab abab c", False), (5, "", False), (6, "AB b", True)]
    out = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(texts, "doc_id long, text string, train boolean"), "train", pieces, rounds=0).collect()}
    lattice = lm.Lattice(pieces)
    counts = Counter(w for _, t, train in texts if train for w in (t or "").lower().split())
    ends = sum(train for *_, train in texts)
    total = counts.total() + ends
    for key, text, _ in texts:
        words = (text or "").lower().split()
        paths = {w: brute_word(w, lattice, pieces) for w in words}
        plain = sum(math.log10(paths[w]) for w in words) + lattice.logp[-1] / math.log(10)
        full = sum(math.log10(max(counts[w] - lm.DISCOUNT, 0) / total + lm.DISCOUNT * len(counts) / total * paths[w]) for w in words) + math.log10(ends / total)
        assert math.isclose(out[key].lattice_score, plain) and math.isclose(out[key].score, full)


def test_expectation_raises_likelihood():
    pieces = lm.vocabulary(P.path("piece_bpe_32k.model"))
    words, n = ["thing", "things", "nothing", "singing", "th"], np.array([5.0, 3, 2, 2, 9])
    logp, before = lm.Lattice(pieces).logp, -np.inf
    for _ in range(4):
        score, used = lm.Lattice(pieces, logp).score(words, n)
        assert (score * n).sum() > before
        before = (score * n).sum()
        logp = np.log((used + 1e-9) / (used + 1e-9).sum())


def base_of(texts, train):
    split = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    c = Counter(w for ws, t in zip(split, train) if t for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    return [(len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, None])) for ws in split]


@pytest.mark.parametrize("share", [lm.SHARE, 0.02])
def test_lm_edge_cases(spark, docs, no_docs, share):
    pieces = lm.vocabulary(P.path("piece_bpe_32k.model"))
    marked = docs.withColumn("train", F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True)))
    rows = [(r.doc_id, r.text, r.train) for r in marked.collect()]
    want = sorted([(d, t, *b[:3], round(b[3], 6)) for (d, _, t), b in zip(rows, base_of([r[1] for r in rows], [r[2] for r in rows]))], key=repr)
    out = lm.score_documents(marked, "train", pieces, "lang", share=share).collect()
    assert sorted([(r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out], key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert lm.score_documents(no_docs.withColumn("train", F.lit(True)), "train", pieces, "lang").count() == 0
    none = lm.score_documents(docs.withColumn("train", F.lit(False)), "train", pieces, rounds=1).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)


def test_op7(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    train = [zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in rows]
    want = {d: (not t, b) for (d, _), t, b in zip(rows, train, base_of([r[1] for r in rows], train))}
    got = {r.doc_id: r for r in catalog.op7_lm_score(spark, sf).collect()}
    assert got.keys() == want.keys()
    for d, (held, (n, known, total, base)) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = catalog.op3_toxicity(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [(toxic[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in toxic]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert np.mean([b for a, b in held if a]) > 0.85


def test_misspellings_share_runs():
    good = [f"plain words number {i} about weather and trees" for i in range(60)]
    bad = [f"you worthless idiot number {i} about weather and trees" for i in range(60)]
    model = toxicity.train(good + bad, [0] * 60 + [1] * 60)
    score = model.score(toxicity.logits(iter(["worthlesss idiott weather", "lovely weather and trees", None, "", "number"]), model))
    assert score[0] > 0.5 > score[1]


def test_score_is_that_of_its_bag_in_any_blocks(docs, monkeypatch):
    texts = [r.text for r in docs.collect()]
    model = toxicity.Model(np.random.default_rng(1).standard_normal(toxicity.BUCKETS), 0.25)
    want = [(model.weights[at] * share).sum() + 0.25 for at, share in map(toxicity.bag, texts)]
    for block in (toxicity.BLOCK, 50):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        np.testing.assert_allclose(toxicity.logits(iter(texts), model), want, rtol=1e-4, atol=1e-4)


def test_toxicity_edge_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (4, 1, None), (999, 1, 1), (5, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0), F.lit(True))).where("score > 0").where("score >= 0.5").count() == 0
    assert toxicity.score(no_docs, model).count() == 0


def test_best_cut_is_that_of_all_cuts():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30):
        odds, y, weight = rng.integers(-4, 4, n).astype(float), rng.integers(0, 2, n), rng.random(n) + 0.1
        y[0] = 1
        f1 = lambda cut: 2 * weight[(odds > cut) & (y == 1)].sum() / (weight[odds > cut].sum() + weight[y == 1].sum())
        assert math.isclose(f1(toxicity.best_cut(odds, y, weight)), max(f1(c - 0.5) for c in odds))


def test_toxicity_sample_is_not_cut_by_length(spark):
    rows = [(i, "word " * (40_000 if i % 10 == 0 else 5), i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    taken = toxicity.sample(docs, labels, F.lit(True)).collect()
    assert {r.doc_id for r in taken} == set(range(60)) and all(r.stands_for == 1 and r.toxic == r.doc_id % 2 for r in taken)
    few = toxicity.sample(docs, labels, F.lit(True), per_class=5, class_chars=10**9).collect()
    assert sorted((r.toxic, r.stands_for) for r in few) == [(0, 2.0)] * 15 + [(1, 6.0)] * 5
    # Rows are taken in order until the characters are passed; the one that passes them is taken whole.
    short = toxicity.sample(docs, labels, F.lit(True), class_chars=100_000).collect()
    assert 0 < sum(r.toxic for r in short) and all(len(r.text) in (25, 200_000) for r in short)


def test_bag_of_a_long_text_in_blocks(monkeypatch):
    text = "".join(f"word{i % 900} of{i} " for i in range(20_000))
    at, share = toxicity.bag(text)
    monkeypatch.setattr(toxicity, "BLOCK", 10**9)
    whole_at, whole_share = toxicity.bag(text)
    assert abs(share.sum() - whole_share.sum()) < 1e-3 and len(set(at) ^ set(whole_at)) < 50


def test_kinds_are_bounded(spark):
    """Of many kinds the commonest keep their own number, all others share the last."""
    rows = [(f"k{i:02d}", True) for i in range(40) for _ in range(1 + (i % 20 == 3) * 5)] + [("only held out", False), (None, True), (None, True)]
    frame = spark.createDataFrame(rows, "lang string, train boolean")
    marked, kinds = lm.kinds_of(frame, "train", "lang")
    got = {(r.lang, r.k) for r in marked.collect()}
    assert kinds == lm.KINDS and {k for _, k in got} == {-1, *range(lm.KINDS)}
    assert len({k for x, k in got if x in (None, "k03", "k23")}) == 3 and len([x for x, k in got if k == lm.KINDS - 1]) == 41 - (lm.KINDS - 1)
    few, n = lm.kinds_of(frame.where("lang < 'k03'"), "train", "lang")
    assert n == 3 and {(r.lang, r.k) for r in few.collect()} == {("k00", 0), ("k01", 1), ("k02", 2)}
    assert lm.kinds_of(frame.limit(0), "train", "lang")[1] == 1


def test_trainer_holds_one_copy_of_the_bags():
    """Bags are made as batches come and thinned in place; the model is that of the texts."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words[: 200 + 200 * (i % 2)], 60)) for i in range(80)]
    marks = [i % 2 for i in range(80)]
    bags = [toxicity.bag(t) for t in texts]
    before = sum(len(at) for at, _ in bags)
    want, got = toxicity.train(texts, marks, steps=20), toxicity.train_bags(bags, marks, steps=20)
    assert np.array_equal(want.weights, got.weights) and want.constant == got.constant
    assert sum(len(at) for at, _ in bags) < before
