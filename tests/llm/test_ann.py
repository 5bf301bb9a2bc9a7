"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, catalog


def brute(rows, queries, k):
    """rows: {id: vector}; exact answers by query."""
    ids = sorted(rows)
    matrix = np.array([rows[i] for i in ids], dtype=float)
    out = {}
    for q in queries:
        d = np.sqrt(((matrix - np.array(rows[q], dtype=float)) ** 2).sum(axis=1))
        out[q] = sorted((x, i) for x, i in zip(d.tolist(), ids) if i != q)[:k]
    return out


def test_edge_rows_ties_and_copies(spark):
    rng = np.random.default_rng(2)
    good = {i: rng.standard_normal(4).round(1).tolist() for i in range(120)}
    copies = {1000 + i: good[0] for i in range(40)}
    bad = [(500, None), (501, [0.0] * 4), (502, [1.0, None, 1.0, 1.0]), (503, [1.0, float("nan"), 1.0, 1.0]), (504, [1.0, float("inf"), 0.0, 0.0]), (505, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows = good | copies
    frame = spark.createDataFrame([*rows.items(), *bad, (7, good[7])], "vec_id long, embedding array<float>").withColumn("entry", F.lit(1)).withColumn("tree", F.lit(1))
    exact = {i: np.array(v, dtype=np.float32).tolist() for i, v in rows.items()}
    want = brute(exact, [i for i in rows if i % 10 == 0], 5)
    got = {}
    for r in ann.nearest(frame, F.col("id") % 10 == 0, 5, leaf=30, probes=10_000, part=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.id))
    assert got.keys() == want.keys()
    for q, answers in got.items():
        assert [a[0] for a in sorted(answers)] == list(range(1, 6))
        assert [a[2] for a in sorted(answers)] == [i for _, i in want[q]]
        np.testing.assert_allclose([a[1] for a in sorted(answers)], [d for d, _ in want[q]], rtol=1e-12)


def test_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.id) for r in ann.nearest(frame, F.col("id") == 0).collect()] == [(0, 1, 1)]
    assert ann.nearest(frame.where("vec_id = 0"), F.col("id") == 0).count() == 0
    assert ann.nearest(frame.limit(0), F.col("id") == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_op8(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()}
    want = brute(rows, [i for i in rows if i % 100 == 0], 10)
    got = {}
    for r in catalog.op8_ann(spark, path).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for _, i in want[q]} & got[q].keys()) / 10 for q in want]) >= 0.9


def test_queue_probes_nearest_leaves_first_across_trees():
    rng = np.random.default_rng(3)
    sample = rng.standard_normal((4000, 16)).astype(np.float32)
    forest = ann.Forest(sample, trees=4, leaf=50)
    own = forest.leaves(sample[:5])
    for i in range(5):
        probes = forest.probe(sample[i], 40)
        assert probes[:4] == [(t, own[t, i]) for t in range(4)]  # its own leaf of every tree costs nothing
        assert len(set(probes)) == 40
    assert np.bincount(forest.leaves(sample)[0]).max() <= 80


REAL = ann.calibrated


def recall_and_share(spark, vectors, monkeypatch, **sizes):
    """Recall against brute force and the share of all vectors that a query's leaves hold."""
    probed = []
    real = REAL
    monkeypatch.setattr(ann, "calibrated", lambda forest, *a, **kw: probed.append((forest, real(forest, *a, **kw))) or probed[0][1])
    rows = dict(enumerate(vectors.tolist()))
    frame = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    want = brute(dict(enumerate(vectors.astype(np.float32))), [i for i in rows if i % 50 == 0], 10)
    got = {}
    for r in ann.nearest(frame, F.col("id") % 50 == 0, **sizes).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    forest, n = probed[0]
    own = [{(t, leaf) for t, leaf in forest.probe(vectors[q].astype(np.float32), n)} for q in want]
    leaves = forest.leaves(vectors.astype(np.float32))
    share = np.mean([np.mean(np.any([np.isin(leaves[t], [x for s, x in o if s == t]) for t in range(len(leaves))], axis=0)) for o in own])
    return np.mean([len({i for _, i in want[q]} & got[q]) / 10 for q in want]), share, forest


def test_probes_follow_the_vectors(spark, monkeypatch):
    """Clustered vectors take a small share of the table, vectors without structure a large one; trees reach below their own directions."""
    monkeypatch.setattr(ann, "OWN_LEVELS", 3)
    rng = np.random.default_rng(5)
    clustered = rng.standard_normal((200, 32))[rng.integers(0, 200, 8000)] + 0.15 * rng.standard_normal((8000, 32))
    recall, share, forest = recall_and_share(spark, clustered, monkeypatch, leaf=64, part=40)
    assert recall >= 0.9 and share < 0.1 and forest.depth == 7
    recall, share, _ = recall_and_share(spark, rng.standard_normal((8000, 32)), monkeypatch, leaf=64)
    assert recall >= 0.9 and 0.1 < share < 0.8


def test_depth_follows_the_table_as_far_as_the_sample_bears():
    sample = np.random.default_rng(1).standard_normal((1000, 4)).astype(np.float32)
    assert ann.Forest(sample, 1, 10, rows=1000).depth == 7
    assert ann.Forest(sample, 1, 10, rows=10**9).depth == 7
    assert ann.Forest(sample, 1, 100, rows=1000).depth == 4
    assert ann.Forest(sample[:0], 2).depth == 0


def test_ids_with_several_vectors_are_named_once(spark):
    """Ids repeat with other vectors, one of them a hundred times; k distinct ids come back, each at its least distance."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(3).round(2).tolist()) for i in range(60)]
    rows += [(i, rng.standard_normal(3).round(2).tolist()) for i in (0, 5, 5, 8, 35, 0)] + [(5, (np.array(rows[0][1]) + 0.001 * j).round(3).tolist()) for j in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows]
    got = {}
    for r in ann.nearest(frame, F.col("id") % 10 == 0, 10, leaf=16, probes=10_000, part=12).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for q in range(0, 60, 10):
        least = {}
        for i, v in exact:
            for j, w in exact:
                if i == q and j != q:
                    least[j] = min(least.get(j, np.inf), float(np.sqrt(((v - w) ** 2).sum())))
        want = sorted((d, j) for j, d in least.items())[:10]
        assert [a[1] for a in sorted(got[q])] == [j for _, j in want]
        np.testing.assert_allclose([a[2] for a in sorted(got[q])], [d for d, _ in want], rtol=1e-12)
