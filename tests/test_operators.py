"""Operators on small hand-made inputs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.functions import hashing, text
from tessella.operators import chunking, dedup, gate, lexicon, metrics, profile, retrieval, splits
from tessella.operators.graph import connected_components


def one(spark, column, value, ddl="string"):
    return spark.createDataFrame([(value,)], f"x {ddl}").select(column(F.col("x")).alias("y")).first().y


def test_clean_and_keys(spark):
    assert one(spark, text.clean_text, "　a \t b\n\n\n\nc ") == "a b\n\nc"
    assert one(spark, text.clean_text, None) == ""
    assert one(spark, text.unique, [" a", "b", "a ", ""], "array<string>") == ["a", "b"]
    assert one(spark, text.dedupe_key, "Äb-C 中!1") == "bc中1"
    assert [one(spark, text.dedupe_key, t) for t in ("Straße", "STRASSE", "STRAẞE", "ﬁn", "ſo", "İ")] == ["strasse", "strasse", "strasse", "fin", "so", "i"]
    assert one(spark, text.strip_html, "a < b and c > d") == "a < b and c > d"
    assert one(spark, text.strip_html, "<p class='x'>a</p> <!-- b > c --> 1 <2> <br/>d <!DOCTYPE x>") == "a  1 <2> d "
    assert sorted(one(spark, text.char_ngrams, "abcab")) == ["abc", "bca", "cab"]
    assert one(spark, text.char_ngrams, "ab") == ["ab"] and one(spark, text.char_ngrams, "") == []
    assert one(spark, lambda c: text.grams_of(c, 2), "a😀b") == ["a😀", "😀b"]


def test_tokenize_keeps_grams_of_cjk_and_ascii_words(spark):
    assert one(spark, text.tokenize, "口苦咽干 a Ab12") == ["口苦咽干", "口苦", "苦咽", "咽干", "口苦咽", "苦咽干", "ab12"]


def test_cleaning_masks(spark):
    out = spark.createDataFrame([("<b>我叫张三，电话 13812345678， a.b@c.de</b> http://x.y/z",)], "x string")
    cleaned, counts = text.clean_record(F.col("x"))
    r = out.select(cleaned.alias("t"), *[c.alias(k) for k, c in counts.items()]).first()
    assert r.t == "[NAME]，电话 [PHONE]， [EMAIL] [URL]"
    assert (r.name, r.phone, r.email, r.url) == (1, 1, 1, 1)


def test_polarity(spark):
    rows = [("I have no fever now", "absent"), ("maybe some fever", "uncertain"), ("a fever", "present"), ("no cold, but a long long fever", "present")]
    frame = spark.createDataFrame(rows, "x string, want string").withColumn("at", F.locate("fever", F.col("x")))
    assert all(r.got == r.want for r in frame.select("want", text.polarity(F.col("x"), F.col("at"), r"\bno ", r"\bmaybe ").alias("got")).collect()[:1])
    assert frame.select(text.polarity(F.col("x"), F.col("at"), r"\bno ", r"\bmaybe ").alias("got")).collect()[3].got == "present"


def test_near_duplicates(spark):
    base = "a question about sleeping badly for three weeks and waking early"
    rows = spark.createDataFrame([(0, base), (1, base + "!"), (2, "an entirely different text about something else"), (3, base)], "id long, t string").withColumn("k", text.dedupe_key(F.col("t")))
    got = {r.id: r.component for r in dedup.near_duplicate_components(rows, "id", "k", 0.8).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0}
    links = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    members = spark.createDataFrame([(i, 0) for i in range(3)], "id long, component long")
    assert {r.id for r in dedup.greedy_dropped(links).collect()} == {1}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {200: 200, 201: 200}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_lexicon_choices(spark):
    texts = spark.createDataFrame([(1, "abcd bcd"), (2, None)], "id long, t string")
    terms = spark.createDataFrame([("ab",), ("bcd",), ("cd",)], "term string")
    hits = lexicon.match_terms(texts, "id", "t", terms, [2, 3])
    assert Counter((r.term, r.start) for r in hits.collect()) == Counter([("ab", 1), ("bcd", 2), ("cd", 3), ("bcd", 6), ("cd", 7)])
    chosen = lambda **k: [(c.start, c.term) for c in lexicon.non_overlapping(hits, **k).first().chosen]
    assert chosen() == [(2, "bcd"), (6, "bcd")]
    assert chosen(longest_first=False) == [(1, "ab"), (3, "cd"), (6, "bcd")]


def test_fusion_adds_equal_weights(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query int, key string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2)], "query int, key string, rank int")
    got = {r.key: (r.rrf_score, r.n_routes, r.best_rank) for r in retrieval.rrf({"a": a, "b": b}).collect()}
    assert got["x"] == pytest.approx((1 / 61 + 1 / 62, 2, 1)) and got["x"] == pytest.approx(got["y"])


def test_diversify_puts_the_preferred_at_its_identitys_first_place(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0), (1, "b", 2, 0), (1, "a", 3, 9), (1, "c", 4, 0)], "q int, who string, pos int, good int")
    out = sorted(retrieval.diversify(rows, "q", "who", "pos", [F.desc("good")], 4).collect(), key=lambda r: r.slot)
    assert [(r.who, r.pos) for r in out] == [("a", 3), ("b", 2), ("c", 4), ("a", 1)]


def decision(spark, **values):
    base = {"intent": "clinical_symptom", "needs_more": False, "n_terms": 3, "has_match": True, "exact": 0, "canonical": 3, "query_cov": 1.0, "groups_total": 2, "groups_missing": 0, "negative": 0, "forbidden": 0, "confidence": 0.9, "indistinct": False} | values
    status, reasons = gate.decide({k: F.lit(v) for k, v in base.items()})
    return tuple(spark.range(1).select(status.alias("s"), reasons.alias("r")).first())


def test_gate(spark):
    assert decision(spark) == ("grounded", [])
    assert decision(spark, intent="unknown") == ("no_match", ["unknown_intent"])
    assert decision(spark, has_match=False) == ("clarify", ["no_grounded_match"])
    assert decision(spark, has_match=False, n_terms=0) == ("no_match", ["no_grounded_match"])
    assert decision(spark, groups_missing=1, confidence=0.5) == ("clarify", ["missing_required_symptom_groups", "payload_evidence_confidence_below_threshold"])
    assert decision(spark, groups_total=0, canonical=2) == ("clarify", ["too_few_payload_matches"])
    assert decision(spark, indistinct=True, query_cov=0.5, negative=1, forbidden=1, needs_more=True, n_terms=0)[1] == [
        "translator_needs_more_info", "no_canonical_terms", "negative_evidence_conflict", "forbidden_evidence_conflict", "low_query_coverage", "competing_indistinguishable_matches",
    ]
    assert decision(spark, intent="herb_knowledge", canonical=1) == ("clarify", ["insufficient_knowledge_match"])
    assert decision(spark, intent="herb_knowledge", exact=1, canonical=0) == ("grounded", ["direct_knowledge_evidence_match"])
    assert decision(spark, intent="herb_knowledge", groups_missing=1) == ("clarify", ["missing_required_knowledge_groups"])


def test_group_recall_with_synonyms(spark):
    rows = spark.createDataFrame([([["a", "a2"], ["b"]], ["a2", "b", "c"])], "groups array<array<string>>, pred array<string>")
    r = metrics.group_recall(rows, "groups", "pred").first()
    assert (r.group_recall_1, r.group_recall_2, r.case_all_1, r.case_all_2, r.case_any_1, r.mrr) == (0.5, 1.0, 0.0, 1.0, 1.0, 1.0)


def test_percentile_definitions(spark):
    r = metrics.percentiles(spark.createDataFrame([(float(i),) for i in range(1, 21)] + [(None,)], "v double"), "v", 0.95).first()
    assert (r.n, r.p_ceil, r.p_round, r.p_int) == (20, 19.0, 19.0, 20.0)


def test_splits_keep_components_whole_and_upsert_keeps_places(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (10, 11)], "a long, b long")
    rows = splits.component_split(pairs, "a", "b", 0.5).collect()
    assert len({r.split for r in rows if r.component == 1}) == 1 and len(rows) == 5
    base = spark.createDataFrame([("x", 1, 1), ("y", 2, 2)], "k string, v int, pos long")
    patch = spark.createDataFrame([("x", 9, 1), ("z", 8, 2)], "k string, v int, pos long")
    assert sorted((r.pos, r.k, r.v) for r in splits.upsert(base, patch, "k", "pos").collect()) == [(1, "x", 9), (2, "y", 2), (4, "z", 8)]


def test_allocation_is_disjoint_and_balance_takes_turns(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 2, i) for i in range(30)], "id long, a int, b int, q long")
    got = splits.allocate(rows, "id", {"a": F.col("a"), "b": F.col("b")}, 5).collect()
    assert len(got) == 10 and len({r.id for r in got}) == 10
    assert sorted(Counter((r.a, r.b) for r in splits.balance(rows, "a", "b", "q", "id", 12).collect()).values()) == [2] * 6


def test_json_profile_and_reconcile(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 1.5, "b": null}',), ("[1]",), ('{"a": true, "c": [1], "d": {"e": 1}}',)], "j string")
    got = {(r.key, r.type): r.n for r in profile.json_profile(rows, "j").collect()}
    assert got == {("a", "int"): 1, ("a", "float"): 1, ("a", "bool"): 1, ("b", "str"): 1, ("b", "null"): 1, ("c", "list"): 1, ("d", "dict"): 1, ("<non_object_record>", "other"): 1}
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "t string"), spark.createDataFrame([("x",), ("y",)], "t string")
    assert [tuple(r) for r in profile.reconcile(a, b, "t").collect()] == [("x", 2, 1)]


def test_chunks(spark):
    doc = "# A\n" + "a" * 50 + "\n## B\n" + "b" * 5000 + "\n# C\nend"
    rows = chunking.parents(spark.createDataFrame([(1, doc), (2, ""), (3, None)], "id long, t string"), "id", "t").collect()
    assert {r.key for r in rows} == {1} and all(len(r.parent) <= 3500 + 900 for r in rows)
    assert rows[0].parent.startswith("# A") and rows[-1].parent.endswith("end") and rows[0].parent_id == "1_parent_0"
    kids = chunking.children(spark.createDataFrame([(1, "p", "x" * 1000)], "key long, parent_id string, parent string")).collect()
    assert [len(k.child) for k in kids] == [400, 400, 360]


def test_stable_hashes(spark):
    import hashlib

    want = hashlib.sha256("a\x1f1".encode()).hexdigest()[:24]
    assert spark.range(1).select(hashing.stable_id(F.lit("a"), F.lit(1)).alias("h")).first().h == want
    values = spark.range(2000).select(hashing.stable_split(F.col("id"), 0.15, "s").alias("s")).groupBy("s").count().collect()
    assert 200 < {r.s: r["count"] for r in values}["dev"] < 400
    assert one(spark, lambda c: hashing.confidence(c, F.lit("")), "bad") == 0.0 and one(spark, lambda c: hashing.confidence(c, F.lit("")), None) == 0.6
