"""Whitening against numpy over whole tables."""

import math
import random

import numpy as np
import pytest

from tessella.llm import catalog, whiten

ROWS = "vec_id long, embedding array<float>, n long, x array<long>, component string"


def brute(rows, k=16):
    """rows: (vec_id, vector) that take part; gives n, deviations, covariance, eigenvalues and eigenvectors, falling."""
    xs = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in rows]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in xs]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    whole = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in xs])
    return n, dev, cov, e[::-1], v[:, ::-1], whole


def check(got, rows, k=16):
    n, dev, cov, e, v, whole = brute(rows, k)
    k = min(k, len(e))
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    w = np.array([[by[i][c + 1].whitened for c in range(k)] for i, _ in rows])
    want = whole @ v[:, :k] / np.sqrt(e[:k])
    signs = np.sign((w * want).sum(axis=0))
    assert np.allclose(w, want * signs, atol=1e-8)
    assert all(by[i][1].deviation == d for (i, _), d in zip(rows, dev))
    assert np.allclose([by[rows[0][0]][c + 1].explained for c in range(k)], e[:k] / np.trace(cov))


def test_op11(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(catalog.op11_whiten(spark, sf).collect(), rows)


def test_nulls_copies_and_clashing_columns(spark):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1 + d) for d in range(5)] for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[7]) for i in range(900)]
    bad = [(5000, None), (5001, []), (5002, [1.0, None, 1.0, 1.0, 1.0]), (5003, [1.0, float("nan"), 0.0, 0.0, 0.0]), (5004, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (5005, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, [1], "a") for i, v in rows + bad], ROWS).repartition(16)
    check(whiten.whiten(table).collect(), rows)
    nameless = spark.createDataFrame([(None, v, 1, [1], "a") for v in vectors[:20]] + [(1, vectors[0], 1, [1], "b")] * 2, ROWS)
    got = whiten.whiten(nameless).collect()
    assert sum(r.vec_id is None for r in got) == 100 and sum(r.vec_id == 1 for r in got) == 10 and {r.n for r in got} == {20}


def test_without_variance_and_without_rows(spark):
    assert whiten.whiten(spark.createDataFrame([], ROWS)).count() == 0
    same = whiten.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0, None, None) for i in range(3)], ROWS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, 0.0, 0.0)] * 6
    line = whiten.whiten(spark.createDataFrame([(i, [float(i), 2.0], 0, None, None) for i in range(4)], ROWS)).collect()
    assert {r.whitened is None for r in line if r.component == 2} == {True}
    assert sorted(round(abs(r.whitened), 6) for r in line if r.component == 1) == [0.447214, 0.447214, 1.341641, 1.341641]


def test_chan_merge_is_exact_under_a_large_mean():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(5000, 6)) * 3 + 1e6
    parts = np.array_split(points, 37)
    total = (0, np.zeros(6), np.zeros((6, 6)))
    for p in parts:
        total = whiten.chan_merge(total, whiten.local_moments(p, 50))
    assert total[0] == 5000
    centred = points - points.mean(axis=0)
    assert np.allclose(total[2], centred.T @ centred, rtol=1e-9)


@pytest.mark.parametrize("wide", [False, True])
def test_gaps_and_deviations(wide):
    x = np.array([[2**40, -(2**40)], [3, 4]])
    gap = whiten.gaps(x, 2, [5, 6], wide)
    assert gap.tolist() == [[2**41 - 5, -(2**41) - 6], [1, 2]]
    assert whiten.deviations(gap, wide) == [None, 5]
