"""The longest-first choice of terms over documents against brute force."""

from pyspark.sql import functions as F

from tessella.operators import matcher
from tessella.plans.catalog import QUERIES
from tessella.plans.retrieval import entry_terms

SF = "/root/testdata/sf0.001"


def brute(text, terms):
    found = [(i + 1, t) for t in terms for i in range(len(text)) if text.startswith(t, i)]
    taken, out = set(), []
    for start, t in sorted(found, key=lambda x: (-len(x[1]), x[0], x[1])):
        own = set(range(start, start + len(t)))
        if not own & taken:
            taken |= own
            out.append((start, t))
    return out


def test_all_lengths_inside_words(spark):
    terms = ["ab", "bcd", "cdefghijk", "efghijklmnop", "a", "12", "été"]
    texts = {1: "xabcdefghijklmnopq ab_12, abcdefghijk", 2: "", 3: None, 4: "été a😀bcd-bcdbcd"}
    frame = spark.createDataFrame(list(texts.items()), "id long, t string")
    got = matcher.find_terms(frame, "id", F.col("t"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, *c) for i, t in texts.items() for c in brute(t or "", terms))


def test_documents(spark):
    terms = [r.term for r in entry_terms(spark, SF).select("term").distinct().collect()]
    assert max(map(len, terms)) > 7
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 300").select("doc_id", F.lower("text").alias("t")).collect()[:40]
    want = sorted((r.doc_id, *c) for r in docs for c in brute(r.t, terms))
    assert want
    ids = [r.doc_id for r in docs]
    assert sorted(map(tuple, QUERIES["lexicon_longest_non_overlap"](spark, SF).where(F.col("doc_id").isin(ids)).collect())) == want
