"""Cleaning, flattening and the search core against plain Python."""

import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessella.functions import payload, text
from tessella.operators import curation, search
from tessella.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TRICKY = [
    None, "", "  ", "a &amp; b &lt;i&gt;x&lt;/i&gt; &#20013;", "<p>tag</p> 3 < 4", "see WWW.x.y/z, http://a.b?c=1", "tel +86 13812345678 and 13812345678901", "id 11010519491231002X end", "微信号: abc_123 QQ12345 wechat me",
    "我叫张三 姓名：李四", "家住北京市朝阳区某路，好", "bad\x00ctl\x1fx\u00a0y\u3000z", "mail a.b+c@d-e.org, x@y", "e\u0301 \ufb01", "x" * 100_000 + " a@b.cc",
]


def cleaned(value):
    """The pipeline, step by step."""
    now = unicodedata.normalize("NFC", html.unescape(value or ""))
    if "<" in now and ">" in now:
        now = re.sub("<[^>]*>", "", now)
    n = {}
    now, n["url"] = re.subn(r"(?i)https?://\S+|www\.\S+", "[URL]", now)
    now, n["control"] = re.subn(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", now)
    for name, pattern, token in text.MASKS:
        now, n[name] = re.subn(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), pattern.replace("(?U)", "")), token, now)
    return re.sub(r"\s+", " ", now).strip(), n


def test_clean_record(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out, counts = text.clean_record(F.col("text"))
    frame = spark.createDataFrame(rows, "id long, text string").select("id", out.alias("t"), *[c.alias(k) for k, c in counts.items()])
    got = {r.id: r for r in frame.collect()}
    for i, t in rows:
        want, n = cleaned(t)
        assert got[i].t == want, (i, got[i].t[:200], want[:200])
        assert {k: got[i][k] for k in n} == n
    assert got[3].html == 1 and QUERIES["clean_record"](spark, SF).count() == len(rows) - len(TRICKY)


def test_flatten_any_schema(spark):
    row = [("a", ["b", None, ""], [{"x": "c", "y": "d"}], [["e"], ["f", "g"]], 7, {"k": "h"}), (None, None, None, None, None, None)]
    rows = spark.createDataFrame(row, "s string, l array<string>, d array<struct<x:string,y:string>>, n array<array<string>>, i int, m map<string,string>")
    got = [r.v for r in rows.select(payload.values(rows, ["s", "l", "d", "n", "i", "m"]).alias("v")).collect()]
    assert got == [list("abcdefg") + ["7", "h"], []]
    assert [r.t for r in rows.select(payload.labelled_text(rows, ["s", "l", "i"], 12).alias("t")).collect()] == ["s: a\nl: b\ni:", ""]
    flags = spark.createDataFrame([("abc", "b"), ("abc", ""), (None, "b")], "t string, x string").select(payload.contains_term(F.col("t"), F.col("x")).alias("y"))
    assert [r.y for r in flags.collect()] == [True, False, False]


def test_source_priority(spark):
    kinds = ["formula_syndrome", "classical_clause", "classical_acupuncture", "herb_indication", "classical_theory", "classical_acupuncture_principle", "other", None]
    rows = [(k, i, v) for k in kinds for i in ["clinical_symptom", "herb_indication", "classical_theory", "acupuncture_principle", "formula_knowledge", "unknown", None] for v in ["formula", None]]
    got = spark.createDataFrame(rows, "k string, i string, v string").select("k", "i", "v", search.source_priority(F.col("k"), F.col("i"), F.col("v")).alias("p")).collect()

    def want(k, i, v):
        by = {"herb_indication": {"herb_indication": 6}, "classical_theory": {"classical_theory": 6}, "acupuncture_principle": {"classical_acupuncture_principle": 6}, "clinical_symptom": {"formula_syndrome": 5, "classical_acupuncture": 5, "classical_clause": 4}}
        if i in by:
            return by[i].get(k, 0)
        if i == "formula_knowledge":
            return {"formula_syndrome": 6, "classical_clause": 5}.get(k, 4 if v else 0)
        return {"formula_syndrome": 4, "classical_clause": 3}.get(k, 2 if v else 1 if k == "classical_theory" else 0)

    assert [(r.k, r.i, r.v, r.p) for r in got] == [(*r, want(*r)) for r in rows]


def test_explanatory_priority(spark):
    rows = [
        ("classical_theory", ["寸口", "脉"], "所谓寸口 故曰", "寸口", "寸口脉", "独取寸口", 1 + 4 + 3 + 2), ("classical_theory", ["脉脉"], "经言", "独取寸口", "", "独取寸口", 5 - 1), ("formula_syndrome", ["脉脉"], "所谓", "脉脉", "", "", 0),
        ("classical_acupuncture_principle", None, None, None, None, None, 0), ("classical_acupuncture_principle", ["a"], "何谓 经言", "a", "", "", 1),
    ]
    frame = spark.createDataFrame(rows, "k string, terms array<string>, t string, d string, q string, a string, want int")
    out = frame.select("want", search.explanatory_priority(*[F.col(c) for c in ("k", "terms", "t", "d", "q", "a")]).alias("got")).collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_evidence_terms_leave_out_forbidden_and_opposites(spark):
    frame = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "c"], ["b"], [["x"]]), (["a", "c"], ["a", "c"], None, [["y"]])], "q array<string>, e array<string>, f array<string>, g array<array<string>>")
    out = frame.select(search.evidence_terms(F.col("q"), F.col("e"), F.col("f"), F.col("g"), {"c": ["x"]}).alias("t")).collect()
    assert [r.t for r in out] == [["a"], ["a", "c"]]


def test_every_gate_branch_and_filter_occurs(spark):
    said = {x for r in QUERIES["search_gate"](spark, "/root/testdata/sf0.01").collect() for x in [r.status, *r.reasons.split(",")]}
    assert {"grounded", "clarify", "no_match", "unknown_intent", "translator_needs_more_info", "low_query_coverage", "direct_knowledge_evidence_match", "missing_required_knowledge_groups"} <= said
    verdicts = {r.verdict for r in QUERIES["hard_filters"](spark, "/root/testdata/sf0.01").collect()}
    assert {"kept", "negative"} <= verdicts


def test_mutation_is_seeded_and_changes_one_pair(spark):
    pairs = [("ab", "ba"), ("cd", "dc")]
    frame = spark.createDataFrame([("ab cd",), ("ab",), ("zz",), (None,)], "t string")
    one, again, other = ([r.m for r in frame.select(payload.mutated(F.col("t"), pairs, s).alias("m")).collect()] for s in ("s", "s", "t7"))
    assert one == again and one[0] in ("ba cd", "ab dc") and one[1:] == ["ba", "zz", None] and other[1:] == one[1:]


def test_reject_and_unsafe(spark):
    rows = spark.createDataFrame([("fine", False, False), ("good", False, True)], "t string, want boolean, got boolean")
    assert [r.t for r in curation.unsafe_answers(rows, "want", "got").collect()] == ["good"]
    assert curation.reject(rows, "t", "bad", "no").count() == 2
    with pytest.raises(Exception, match="no"):
        curation.reject(rows, "t", "goo", "no").collect()


def test_answer_routes(spark):
    rows = [("grounded", "x", "structured"), ("clarify", "clinical_symptom", "clarify"), ("clarify", "herb_indication", "open"), ("no_match", "unknown", "refuse"), ("no_match", "herb_indication", "open")]
    out = spark.createDataFrame(rows, "s string, i string, want string").select("want", payload.answer_route(F.col("s"), F.col("i")).alias("got")).collect()
    assert all(r.want == r.got for r in out)
