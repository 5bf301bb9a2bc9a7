"""URL filter, fingerprints, chat formatting and mixing, against plain Python and SQL."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict
from math import log

import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import catalog, chat, fingerprint, mixing, oracle, urlfilter

SF = "/root/testdata/sf0.001"
URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://a.Example.ORG/es/x", "https://example.org/en/12?a#b", "http://xexample.org/en/1", "http://com/fr/", "http://a.com/de/x?u=http://b.org/",
    "http://a.com?x/de/", "http://a.com#/fr/", "ftp://www.doubleclick.net/x", "http://x.net/ads/1", "http://x.net/bads/1", "http://example.com/ads/policy", "http://x.net/y?sessionid=3", "http://x.net/a.exe", "http://x.net/a.exed",
    "http://x.net/a.exe?z", "http://casino.net/", "http://my-casino.net/", "http://example.org:80/es/", "a://b://org/", "http://x.net/\n/ads/", "http://org/\u0130", "http://org",
]


def judged(url, site):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in site if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.name), r.action == "block"))
        return host, path, best.name, best.action
    text = "".join(c.lower() if c.isascii() else c for c in url or "")
    acts = {a for a, own in (("allow", oracle.ALLOW), ("block", oracle.BLOCK)) if any(re.search(p, text, re.S) for p in own)}
    return host, path, None, "allow" if "allow" in acts or not acts else "block"


def test_urls(spark):
    frame = spark.createDataFrame([(i, u, "x", i) for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string, rank int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(frame, catalog.SITE_RULES).collect()}
    assert got == {i: judged(u, catalog.SITE_RULES) for i, u in enumerate(URLS * 2)}
    assert len({v for *_, v in got.values()}) == 2
    assert urlfilter.judge(frame.limit(0), catalog.SITE_RULES).count() == 0
    assert {r.verdict for r in urlfilter.judge(frame, [], []).collect()} == {"allow"}


def test_rules_are_filed_under_their_rarest_literal(spark):
    frame = spark.createDataFrame([("http://example.org/es/",)] * 3 + [("http://example.org/fr/",)], "url string")
    index = {r.regex: r.token for r in urlfilter.rule_index(frame, urlfilter._rule_frame(spark, catalog.SITE_RULES)).collect()}
    assert index[urlfilter._site_regex(catalog.SITE_RULES[1])] == "es"
    assert urlfilter._literal_tokens(catalog.SITE_RULES[2]) == ["en", "example", "org"]
    assert urlfilter._literal_tokens(urlfilter.PatternRule("block", "ads*")) == []


def canon(text):
    text = unicodedata.normalize("NFKC", text or "").lower()
    return re.sub(r"\s+", " ", text).strip(" ")


def digest(text):
    data = canon(text).encode()
    a = xxhash.xxh64_intdigest(data, 42)
    b = xxhash.xxh64_intdigest(data, xxhash.xxh64_intdigest(fingerprint.SECOND.encode(), 42))
    return f"{a:016x}{b:016x}"


def test_fingerprints(spark, docs, no_docs, tmp_path):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = defaultdict(list)
    for key, text in rows:
        groups[canon(text)].append(key)
    got = sorted((r.key if r.key is not None else -1, r.fingerprint, r.group) for r in fingerprint.exact_groups(docs).collect())
    want = sorted((k if k is not None else -1, digest(t), min((x for x in groups[canon(t)] if x is not None), default=None)) for k, t in rows)
    assert got == want
    assert fingerprint.exact_groups(no_docs).count() == 0


def test_texts_that_share_a_digest_are_set_apart(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "doc_id long, text string")
    same = docs.select(F.col("doc_id").alias("key"), F.struct(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b")).alias("wide"))
    real, fingerprint.wide_hash = fingerprint.wide_hash, lambda canon: F.struct(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b"))
    try:
        got = {r.key: (r.fingerprint, r.group) for r in fingerprint.exact_groups(docs, hashed=same).collect()}
    finally:
        fingerprint.wide_hash = real
    assert got[1][1] == 1 and got[2] == got[3] and got[2][1] == 2 and got[4][1] == 4 and len({f for f, _ in got.values()}) == 3


@pytest.mark.parametrize("case", ["edge", "data", "one digest"])
def test_op9(spark, docs, tmp_path, case, monkeypatch):
    path = SF
    if case != "data":
        more = spark.createDataFrame([(2, "bravo text two"), (2, "charlie other words"), (2, "bravo text two"), (None, "null key too"), (900, "xyz"), (901, "xyz")], "doc_id long, text string")
        docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
        path = str(tmp_path)
    if case == "one digest":
        monkeypatch.setattr(fingerprint, "wide_hash", lambda canon: F.struct((F.length(canon) * 0).cast("long").alias("a"), F.lit(2).cast("long").alias("b")))
    every = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    # Rows that repeat id and text are one document; those of one id follow each other by their texts' SHA-256.
    rows = sorted(set(every), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    got = [r.asDict() for r in catalog.op9_fingerprint(spark, path).collect()]
    want, texts = [], {}
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        row = (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(text), digest(edited), float(canon(text) == canon(edited)), float(canon(text) == canon(after)))
        want += [row] * every.count((key, text))
        texts[row[:3]] = (canon(text), canon(edited))
    if case != "one digest":
        assert sorted([tuple(r.values()) for r in got], key=repr) == sorted(want, key=repr)
        return
    # All texts share a digest: they are told apart by their bytes, across both columns.
    assert sorted([tuple(r.values())[:3] + tuple(r.values())[5:] for r in got], key=repr) == sorted([w[:3] + w[5:] for w in want], key=repr)
    prints = [(f, c) for r in got for f, c in zip((r["fingerprint"], r["edited_fingerprint"]), texts[r["doc_id"], r["n_chars"], r["edited_sha256"]])]
    assert len({f for f, _ in prints}) == len({c for _, c in prints}) == len(set(prints))


def test_chat_round_trip(spark):
    rng = random.Random(1)
    pieces = ["<|im_start|>", "<|im_end|>", "\n", "<", "\\", "|", "a", "<\\|", "assistant", "\u4e2d", "%0A", " "]
    turns = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb%", "<|x"]), rng.choice([None, "", "".join(rng.choices(pieces, k=9))])) for c in range(40) for t in range(rng.randint(1, 9))]
    turns += [(None, 0, "assistant", "x"), (77, None, "user", "y"), (77, 1, "assistant", "z"), (77, 1, "assistant", "z"), (78, 0, "user", "long " * 9000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("ts", F.lit(2)).repartition(3)
    out = chat.format_chat(frame)
    got = defaultdict(list)
    for r in out.withColumn("loss", chat.loss_text(out)).withColumn("said", chat.parse_turns(F.col("formatted"))).collect():
        got[r.conv_id].append(r)
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, want in by.items():
        want = [(role, text) for _, role, text in sorted(want)]
        own = sorted(got[c], key=lambda r: r.example)
        assert [(x.role, x.text) for x in own[-1].said] == want and own[-1].is_last
        replies = [i for i, (role, _) in enumerate(want) if role == "assistant"]
        assert [r.loss for r in own][: len(replies)] == [want[i][1] for i in replies]
        assert [len(r.said) for r in own][: len(replies)] == [i + 1 for i in replies]
        assert len(own) == len(replies) + (not replies or replies[-1] != len(want) - 1)
    assert chat.format_chat(frame.limit(0)).count() == 0


def mixed(rows, entropy, max_repeats, budget, seed):
    """Brute force over (doc_id, source, text)."""
    docs = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in rows]
    sums = Counter()
    for _, s, n in docs:
        sums[s] += n
    sums = {s: n for s, n in sums.items() if n}
    total = sum(sums.values())
    shares = [n / total for n in sums.values()]

    def fits(a):
        z = sum(p**a for p in shares)
        return log(z) - a * sum(p**a * log(p) for p in shares) / z <= entropy * log(len(shares)) and budget * max(p ** (a - 1) for p in shares) / z <= max_repeats

    lo, hi = 0.0, 1.0
    if fits(0.0):
        hi = 0.0
    else:
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    a = round(hi, 6)
    z = sum(p**a for p in shares)
    out = []
    for s, n in sums.items():
        drawn = int((n / total) ** a / z * budget * total + 0.5)
        passes, rest = divmod(drawn, n)
        own = defaultdict(list)
        for d, src, k in docs:
            if src == s:
                own[hashlib.md5("|".join([seed, s or "", str(passes), "" if d is None else str(d)]).encode()).hexdigest()].append((d, k))
        out += [(d, s, b, k) for ds in own.values() for d, k in ds for b in range(passes)]
        run = 0
        for h in sorted(own):
            run += sum(k for _, k in own[h])
            if run > rest:
                break
            out += [(d, s, passes, k) for d, k in own[h]]
    return sorted(out, key=repr), a


@pytest.mark.parametrize("entropy, repeats, budget", [(0.95, 4.0, 1.0), (1.0, 3.0, 2.5), (0.3, 2.0, 0.4)])
def test_mixing(spark, docs, entropy, repeats, budget):
    rng = random.Random(3)
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    rows += [(100 + i, "hot" if i % 3 else f"s{i % 4}", "w " * rng.randint(0, 60)) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("docs", F.lit(1)).withColumn("cut", F.lit("x")).withColumn("passes", F.lit(3))
    slices, mixing.SLICE = mixing.SLICE, 50
    try:
        got = mixing.mix(frame, entropy, repeats, budget, "t")
    finally:
        mixing.SLICE = slices
    assert got.columns[:6] == ["doc_id", "source", "text", "docs", "cut", "passes"]
    want, _ = mixed(rows, entropy, repeats, budget, "t")
    assert sorted(((r.doc_id, r.source, r.block, r.n_tokens) for r in got.collect()), key=repr) == want


def test_mixing_empty(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
