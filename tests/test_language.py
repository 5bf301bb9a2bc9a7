"""Splitters, rewriting, examples, seeds, line grammars, caches and sinks against plain Python."""

import hashlib
import json
import random
from collections import Counter, OrderedDict

import pytest
from pyspark.sql import functions as F

from tessella.operators import examples, lines, recursive, rewrite, seeds
from tessella.plans.catalog import QUERIES
from tessella.sources import files
from tessella.streaming import cache

SF = "/root/testdata/sf0.001"


def plain_split(text, size, overlap, separators):
    """The recursion, as it is usually told."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    sep, left = separators[at], separators[at + 1 :]
    parts = list(text) if not sep else [p for i, x in enumerate(text.split(sep)) if (p := x if i == 0 else sep + x)]
    out, good = [], []

    def merge(own):
        docs, now = [], []
        for d in own:
            if now and sum(map(len, now)) + len(d) > size:
                docs.append("".join(now).strip())
                while now and (sum(map(len, now)) > overlap or sum(map(len, now)) + len(d) > size):
                    now.pop(0)
            now.append(d)
        return [x for x in [*docs, "".join(now).strip()] if x]

    for p in parts:
        if len(p) < size:
            good.append(p)
            continue
        out += merge(good)
        good = []
        out += plain_split(p, size, overlap, left) if left else merge([p])
    return out + merge(good)


def test_recursive_chunks(spark):
    rng = random.Random(2)
    texts = {i: "".join(rng.choice(["a" * rng.randint(1, 30), " ", "\n", "\n\n", "x", "w" * 90, "中文"]) for _ in range(rng.randint(0, 60))) for i in range(120)} | {500: None, 501: "", 502: " \n ", 503: "y" * 5000, 504: "z " * 3000}
    frame = spark.createDataFrame(list(texts.items()), "id long, t string")
    for size, overlap, separators in ((40, 8, recursive.SEPARATORS), (40, 0, recursive.SEPARATORS), (25, 25, ("\n", " ")), (7, 3, ("",))):
        got = {}
        for r in recursive.recursive_chunks(frame, "id", "t", size, overlap, separators).orderBy("key", "chunk").collect():
            got.setdefault(r.key, []).append(r.child)
        assert got == {k: c for k, t in texts.items() if t and (c := plain_split(t, size, overlap, separators))}
        if "" in separators:
            assert all(len(c) <= size for own in got.values() for c in own)


def test_parents(spark):
    text = "# A\n" + "word " * 900 + "\n# B\nshort\n# C\n" + "x" * 9000
    frame = spark.createDataFrame([(1, text), (2, None), (3, "tiny"), (4, "")], "id long, t string")
    got = {}
    for r in recursive.recursive_parents(frame, "id", "t", 500, 2000, 50).collect():
        got.setdefault(r.key, []).append((int(r.parent_id.rsplit("_", 1)[1]), r.parent))
    assert got.keys() == {1, 3} and got[3] == [(0, "tiny")]
    parents = [p for _, p in sorted(got[1])]
    assert all(500 <= len(p) <= 2000 + 502 for p in parents) and any("# B" in p for p in parents)
    assert recursive.merge_remains(["a" * 9, "b", "c" * 9, "d"], 5) == ["a" * 9 + "\n\nb", "c" * 9 + "\n\nd"]
    assert recursive.merge_remains(["a", "b", "c" * 9], 5) == ["a\n\nb\n\n" + "c" * 9] and recursive.merge_remains(["a", "b"], 5) == ["a\n\nb"] and recursive.merge_remains([], 5) == []


def test_fixed_points(spark):
    rules = [("xxy", "x"), ("aa", "a")]
    texts = ["xxxyy", "xxy" * 50, "aaaa b aaa", "", None, "clean", "x" * 40 + "y" * 40]

    def loop(t):
        for old, new in rules:
            while old in t:
                t = t.replace(old, new)
        return t

    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, t string, n int")
    got = {r.id: r.t for r in rewrite.to_fixed_point(frame, "t", rules).collect()}
    assert got == {i: None if t is None else loop(t) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        rewrite.to_fixed_point(frame, "t", [("a", "ab")])
    noted = {"脉": "(pulse)", "脉弦": "(wiry)", "汗": ""}
    frame = spark.createDataFrame([(1, "脉弦(wiry)(wiry)(pulse)数，脉(pulse)(pulse)"), (2, "脉(wiry)(pulse)浮"), (3, None)], "id long, t string")
    assert {r.id: r.t for r in rewrite.without_annotations(frame, "t", noted).collect()} == {1: "脉弦数，脉", 2: "脉浮", 3: None}


def test_training_examples(spark):
    rng = random.Random(4)
    catalogue = [(f"t{i % 23:02d}", i, f"text {i}") for i in range(70)] + [("t01", 1, "text 1"), (None, 5, "x")]
    asked = [(q, f" ask {q % 30} ", f"t{t:02d}") for q in range(40) for t in rng.sample(range(26), rng.choice([1, 3, 22]))] + [(99, " ", "t01"), (98, "no term", None)] + [(0, " ask 0 ", "t00")] * 2
    got = {(r.id, r.term, r.label): (r.other, r.entry) for r in examples.training_examples(spark.createDataFrame(asked, "id long, query string, term string"), spark.createDataFrame(catalogue, "term string, entry long, text string"), 3).collect()}
    index = lambda key, n: int(hashlib.sha256(key.encode()).hexdigest()[:15], 16) % n
    by = {}
    for t, e, _ in catalogue:
        if t:
            by.setdefault(t, set()).add(e)
    terms, want = sorted(by), {}
    expected = {}
    for q, text, t in asked:
        if text.strip() and t:
            expected.setdefault((q, text.strip()), set()).add(t)
    for (q, text), own in expected.items():
        for t in sorted(own & by.keys()):
            want[q, t, 1] = (t, sorted(by[t])[index(f"{q}:{t}", len(by[t]))])
            at = index(f"negative:3:{q}:{t}", len(terms))
            other = next((terms[(at + s) % len(terms)] for s in (0, 1) if terms[(at + s) % len(terms)] not in own), None)
            if other:
                want[q, t, 0] = (other, sorted(by[other])[index(text + other, len(by[other]))])
    assert got == want and any(k[2] == 0 for k in got) and len([k for k in got if k[2] == 1]) > len([k for k in got if k[2] == 0])
    assert examples.training_examples(spark.createDataFrame(asked, "id long, query string, term string"), spark.createDataFrame([], "term string, entry long, text string")).count() == 0


def test_unlike_seeds(spark):
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(30)]
    sets = lambda n: [rng.sample(pool, rng.randint(0, 9)) for _ in range(n)]
    own, used = sets(300), sets(120) + [pool[:12], [], ["w1"]]
    rows = [(i, s + s[:1] if s else None) for i, s in enumerate(own)] + [(1000, pool[:12] + ["odd"]), (1001, pool[:3])]
    got = {r.id for r in seeds.unlike(spark.createDataFrame(rows, "id long, s array<string>"), spark.createDataFrame([(i, s) for i, s in enumerate(used)], "id long, s array<string>"), "id", "s").collect()}

    def near(a, b):
        shared = len(a & b)
        return shared >= 2 and (shared / len(a | b) >= 0.72 or shared / min(len(a), len(b)) >= 0.85)

    assert got == {i for i, s in rows if not any(near(set(s or []), set(u)) for u in used)} and 1000 not in got and 1001 not in got


def test_postings_of_seeds_are_never_broadcast(spark):
    rows = spark.createDataFrame([(i, [f"w{i % 50}", f"w{i % 7}", f"x{i}"]) for i in range(500)], "id long, s array<string>")
    got = seeds.unlike(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "id", "s")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftSemi" in x and "old" in x]


def test_balance_and_styles(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.choice("pqrst"[: 3 + i % 3]), rng.randint(0, 9)) for i in range(400)] + [(1000 + i, "c", "p", i) for i in range(5)]
    frame = spark.createDataFrame(rows, "id long, source string, direction string, quality int")
    got = seeds.balanced(frame, "source", "direction", "quality", "id", 17).collect()
    digest = lambda salt, i: hashlib.sha256(f"{salt}|{i}".encode()).hexdigest()
    for source in "abc":
        left, counts, chosen = [r for r in rows if r[1] == source], Counter(), []
        while left and len(chosen) < 17:
            best = min(left, key=lambda r: (counts[r[2]], -r[3], digest("balance", r[0])))
            left.remove(best)
            counts[best[2]] += 1
            chosen.append(best[0])
        assert sorted(r.id for r in got if r.source == source) == sorted(chosen)
    dealt = seeds.dealt_styles(frame, ["source", "direction"], "id", {"x": 2, "y": 1, "z": 1}).collect()
    assert len(dealt) == len(rows)
    for cell in {(r.source, r.direction) for r in dealt} | {None}:
        own = Counter(r.style for r in dealt if cell in (None, (r.source, r.direction)))
        n = sum(own.values())
        assert all(abs(own[s] - n * share) <= 1.5 for s, share in (("x", 0.5), ("y", 0.25), ("z", 0.25)))


def test_check_seeds(spark):
    rows = [("s", "a", "c1", "0123456789abc", "so 123456789a it is"), ("s", "b", "c2", "short", "short"), ("t", "a", "c2", None, None), ("u", "a", None, "x" * 10, "y")]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "style string, source string, concept string, answer string, question string, key long")
    got = {r.style: tuple(r)[1:] for r in seeds.check_seeds(frame, {"s": 2, "t": 2, "v": 1}).collect()}
    assert got == {"s": (2, 2, 1, 1, "leak,repeat"), "t": (1, 1, 0, 1, "quota,sources,repeat"), "u": (1, 1, 0, 0, "quota,sources"), "v": (0, 0, 0, 0, "quota,sources")}


GRAMMAR = lines.LineGrammar(
    name="[A-Z][a-z]{1,9}", confirm="taste", passed_over=(",", ".", ")"), not_names=("Stop",), fields=(("nature", "taste"), ("use", "for ")), scopes=(("grade", "Part (.+)"),),
    ends_after="use", ends_at=r"\(|note", opening="(", closing=").,", joint=" ",
)


def test_line_blocks(spark):
    text = "intro\nPart one\nGinseng\n.\n,\ntaste  sweet\n.\nfor  the\nheart\n(\nold note\nMint\nnot a block\nPart two\nStop\ntaste x\nMint\n\ntaste cool\nfor heat\n.\nfor colds\nRoot\n,\n,\n,\n,\n,\n,\n,\ntaste far"
    frame = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "Ginseng", "x")], "id long, t string, line string")
    got = [(r.block, r.line, r.name, r.n_lines, r.scopes, r.fields) for r in lines.line_blocks(frame, "id", "t", GRAMMAR).orderBy("block").collect()]
    assert got == [
        (0, 3, "Ginseng", 6, {"grade": "one"}, {"nature": "taste sweet.", "use": "for the heart"}),
        (1, 17, "Mint", 13, {"grade": "two"}, {"nature": "taste cool", "use": "for heat. for colds Root,,,,,,, taste far"}),
    ]


def test_headed_lines_of_random_pages(spark):
    """Blocks of Markdown-like pages, against a scan that looks at one line at a time."""
    rng = random.Random(8)
    line = lambda: rng.choice(["Head", "A short line", "Ends here.", "-", "", "  ", "long " * 14, "longer still " * 6 + "end."])
    texts = {i: "\n".join(line() for _ in range(rng.randint(0, 25))) for i in range(150)}
    from tessella.plans.language import HEADED

    want = []
    for k, t in texts.items():
        own = [(n, " ".join(x.split())) for n, x in enumerate(t.split("\n"), 1) if x.strip()]
        b, body, head = -1, [], None
        for i, (n, x) in enumerate(own):
            after = next((y for _, y in own[i + 1 : i + 8] if y not in ("-", "*", ".")), "")
            if 2 <= len(x) <= 60 and x[-1] not in ".,;:!?" and len(after) >= 60:
                if head:
                    want.append((k, b, *head, len(body)))
                b, body, head = b + 1, [], (n, x)
            elif head:
                body.append(x)
        if head:
            want.append((k, b, *head, len(body)))
    frame = spark.createDataFrame(list(texts.items()), "id long, t string")
    assert sorted((r.key, r.block, r.line, r.name, r.n_lines) for r in lines.line_blocks(frame, "id", "t", HEADED).collect()) == sorted(want)


@pytest.mark.parametrize("ttl", [None, 40.0])
def test_cache_over_batches(spark, tmp_path, ttl):
    """A stream in several batches equals one cache a key, run over all events in order."""
    rng = random.Random(5)
    rows = [(i, 1_000.0 + 10 * i, rng.randint(0, 3), rng.choice("abcdef")) for i in range(240)]
    ddl = "event_id long, ts timestamp, user_id long, event_type string"
    for n in range(4):
        part = [(i, t, u, e) for i, t, u, e in rows if 60 * n <= i < 60 * n + 60]
        spark.createDataFrame(part, "event_id long, s double, user_id long, event_type string").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = cache.lru(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "user_id", "event_type", 3, ttl)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
    got = {r.event: (r.hit, r.evicted) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    held, want = {}, {}
    for i, at, user, name in rows:
        own = held.setdefault(user, OrderedDict())
        hit = name in own and (ttl is None or at - own[name] <= ttl)
        stored = own.pop(name) if hit else (own.pop(name, None), at)[1]
        own[name] = stored
        want[i] = (hit, own.popitem(last=False)[0] if len(own) > 3 else None)
    assert got == want


def test_sinks(spark, tmp_path):
    rows = [(i, "abc"[i % 3] if i % 7 else None) for i in range(100)] + [(1000, "other")]
    frame = spark.createDataFrame(rows, "id long, kind string")
    path = f"{tmp_path}/sinks"
    files.write_sinks(frame.where("kind = 'a'"), path, "kind", ["a", "b"])
    seen = files.write_sinks(frame, path, "kind", ["a", "b", "empty"], 10, [F.desc("id")])
    n = Counter(k for _, k in rows)
    assert seen["a"] == {"total": n["a"], "written": 10, "truncated": True} and seen["empty"] == {"total": 0, "written": 0, "truncated": False}
    assert seen[None]["total"] == n[None] + n["c"] + 1
    for kind in "ab":
        got = sorted(json.loads(x)["id"] for f in (tmp_path / "sinks" / f"kind={kind}").glob("*.json") for x in f.read_text().splitlines())
        assert got == sorted(i for i, k in rows if k == kind)[-10:]
    again = files.write_sinks(frame.where("kind = 'b'"), path, "kind", ["a", "b"])
    assert again["a"]["total"] == 0 and not list((tmp_path / "sinks").glob("kind=a/*.json"))


def test_queries_without_sql(spark):
    """Rows of the queries that no SQL checks, against the plain forms above."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(k, n): hashlib.md5(c.encode()).hexdigest() for k, t in docs.items() for n, c in enumerate(plain_split(t, 400, 80, recursive.SEPARATORS))}
    assert {(r.doc_id, r.chunk): r.child_md5 for r in QUERIES["recursive_chunks"](spark, SF).collect()} == want
    found = {r.doc_id: r for r in QUERIES["required_groups"](spark, SF).collect()}
    assert found.keys() == docs.keys()
    for k, r in found.items():
        assert all(docs[k].lower()[p.start : p.end] == p.term and p.start >= r.phrase_start and p.end <= r.phrase_end for p in r.places)
    assert sum(len(r.groups) for r in found.values()) > len(docs)
    parents = QUERIES["recursive_parents"](spark, SF).groupBy("doc_id").agg(F.sum("n_chars").alias("n")).collect()
    assert len(parents) == sum(1 for t in docs.values() if t) and all(r.n >= 0.9 * len(docs[r.doc_id].strip()) - 4 for r in parents)
