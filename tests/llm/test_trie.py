"""The trie of conversations against a plain recursion."""

import hashlib
import random
import re
import zlib

import pytest

from tessella.llm import catalog, trie

TURNS = "conv_id long, turn long, role string, text string, depth int, words string, above long"


def brute_openings(rows):
    """rows: (conv_id, turn, role, text); the turns (role, text) of every rebuilt conversation."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    convs = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in convs.items()}
    held = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    return {c: convs.get(c - c % 20, [])[: held[c]] + v[held[c] :] for c, v in convs.items()}


def brute_trie(convs):
    if not convs:
        return []
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) if below else 1
        own = (len(nodes[path]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = own + sum(saved[p] for p in below)
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes_of(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{path}/conversations.parquet").collect()]
    assert nodes_of(catalog.op13_trie(spark, path)) == sorted(brute_trie(brute_openings(rows)), key=repr)


def test_edges_of_rows(spark):
    """Nulls, ties, repeated rows, absent bases, turnless conversations, ids of all kinds, and one long conversation that others leave at many turns."""
    rng = random.Random(9)
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, 2, "user", "a b"), (7, 2, "user", "a b"), (7, 2, "assistant", "a"), (-3, 0, "user", "\x85x y"), (41, 1, "user", "only"), (2**62, 1, "u", "t")]
    for c in range(100, 180):
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["hi", "", None, "one two"])) for t in range(rng.randint(1, 6))]
    long = [("user" if t % 2 else "assistant", f"turn {t}") for t in range(400)]
    for c in range(1000, 1400):
        keep = rng.choice([400, rng.randint(1, 399)]) if c > 1000 else 400
        rows += [(c, t, r, x) for t, (r, x) in enumerate(long[:keep])]
        rows += [(c, 1000, "user", f"own {rng.randint(0, 3)}")] if keep < 400 and c % 3 else []
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], TURNS).repartition(7)
    got = nodes_of(trie.trie(*trie.share_openings(trie.numbered(table))))
    assert got == sorted(brute_trie(brute_openings(rows)), key=repr)


def test_no_rows(spark):
    assert trie.trie(*trie.share_openings(trie.numbered(spark.createDataFrame([], TURNS)))).count() == 0
    only_null = spark.createDataFrame([(None, 1, "user", "x", 1, "x", 1)], TURNS)
    assert trie.trie(*trie.share_openings(trie.numbered(only_null))).count() == 0


def test_many_ends_at_one_node(spark):
    """More ids than one chunk holds, negative ones too."""
    convs = {c: [("user", "same")] for c in range(-700, 700)}
    turns = spark.range(-700, 700).selectExpr("id as conv_id", "1L as depth", "'s' as sha", "1L as words")
    got = {r.depth: r.ends_sha256 for r in trie.trie(turns, turns.select("conv_id")).collect()}
    assert got[1] == hashlib.sha256(",".join(map(str, sorted(convs))).encode()).hexdigest()
