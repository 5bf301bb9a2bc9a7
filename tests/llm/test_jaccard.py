"""The Jaccard join against a plain double loop."""

import random
import re

import numpy as np
import pytest

from tessella.llm import catalog, jaccard


def brute_set(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(rows, percent=85):
    """rows: (doc_id, set); (doc_id, size, component) of each."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least.get(root(i))) for i, (d, s) in enumerate(rows)]


def same(got, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)
    want = sorted(brute_components([(d, brute_set(t)) for d, t in rows]), key=repr)
    assert got == want
    return want


def test_op12(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = same(catalog.op12_jaccard(spark, sf), rows)
    assert len({c for _, _, c in want}) < len(want)


def test_documents(docs, no_docs):
    same(jaccard.jaccard_components(docs), [(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.jaccard_components(no_docs).count() == 0


def families(seed=4):
    """Families around the threshold, a common passage, sizes apart, short texts, ids missing and repeated."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    passage = " ".join(word() for _ in range(60))
    texts = [f"{' '.join(word() for _ in range(rng.randint(20, 90)))} {passage}" for _ in range(60)]
    for size, changes, copies in ((200, 3, 120), (200, 8, 60), (60, 3, 60), (1200, 30, 20), (12, 1, 40)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, changes)):
                own[rng.randrange(size)] = word()
            texts.append(" ".join(own[: size - rng.randint(0, size // 20)]))
    walk = [word() for _ in range(150)]
    for _ in range(40):
        walk = walk[3:] + [word() for _ in range(3)]
        texts.append("\t".join(walk).upper())
    texts += ["a", "A b", "a b c", "a b c", "a b c d", "", None, texts[5], texts[5]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[70]), (None, "nameless one two three four"), (None, "nameless one two three four"), (3, texts[200]), (3, texts[200])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("file_rows", [jaccard.FILE_ROWS, 40])
def test_families_whole_and_in_parts(spark, file_rows):
    rows = families()
    table = spark.createDataFrame([(d, t, "x", 1, b"") for d, t in rows], "doc_id long, text string, node string, n int, digest binary").repartition(5)
    want = same(jaccard.jaccard_components(table, file_rows=file_rows), rows)
    assert 10 < len({c for _, _, c in want}) < 250


def test_tree_gives_all_pairs_that_bounds_allow():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (8, 400), dtype=np.uint64)
    sets = [np.unique(np.concatenate([b[: rng.integers(300, 400)], rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)])) for b in base for _ in range(60)]
    points = np.array([np.bincount((s % np.uint64(jaccard.GROUPS)).view(np.int64), minlength=jaccard.GROUPS) for s in sets], dtype=np.uint32)
    sizes, labels = np.array([len(s) for s in sets]), np.arange(len(sets)) // 3
    got = {(min(i, j), max(i, j)) for a, b, _ in jaccard.tree_pairs(points, sizes, labels) for i, j in zip(a.tolist(), b.tolist())}
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            if labels[i] != labels[j] and jaccard._enough(int(np.minimum(points[i], points[j]).sum()), sizes[i], sizes[j], 85):
                want.add((j, i))
    assert got == want and want
