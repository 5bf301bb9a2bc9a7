"""Negation and validators on small inputs."""

from pyspark.sql import functions as F

from tessella.functions import negation
from tessella.operators import validation


def test_negation(spark):
    rows = spark.createDataFrame([("no fever and cough, but pain", ["fever", "cough", "pain"]), ("没有发热、咳嗽，口苦", ["发热", "咳嗽", "口苦"]), (None, ["x"])], "t string, terms array<string>")
    got = [r.n for r in rows.select(negation.negated_terms(F.col("t"), F.col("terms")).alias("n")).collect()]
    assert got == [["fever", "cough"], ["发热", "咳嗽"], []]
    flags = rows.select(negation.is_negated(F.col("t"), "fever").alias("a"), negation.is_negated(F.col("t"), "pain").alias("b")).collect()
    assert [(r.a, r.b) for r in flags] == [(True, False), (False, False), (False, False)]


def test_conflicts_and_synonyms(spark):
    row = spark.range(1).select(
        negation.resolve_conflicts(F.array(*map(F.lit, "abc")), F.array(F.lit("b")), [("a", "c")]).alias("kept"),
        negation.expand_synonyms(F.array(F.lit("a")), {"a": ["x", "y"]}, F.array(F.lit("y"))).alias("more"),
    ).first()
    assert row.kept == ["a"] and row.more == ["a", "y"]


def test_validators(spark):
    rows = spark.createDataFrame([("k1", "", ["a"]), ("k1", "t", []), ("k2", None, [])], "kind string, title string, keys array<string>")
    marked = rows.withColumn("codes", validation.required_fields("kind", {"k1": ["title", "keys"]}))
    assert {(r.code, r.n) for r in validation.histogram(marked, "codes").collect()} == {("missing:title", 1), ("missing:keys", 1)}
    assert {(r.kind, r.rows, r.with_keys) for r in validation.filled(rows, "kind", ["keys"]).collect()} == {("k1", 2, 1), ("k2", 1, 0)}
    assert marked.select(validation.problems({"no_title": F.col("title").isNull()}).alias("p")).collect()[2].p == ["no_title"]


def test_pass_rates_and_leaks(spark):
    cases = spark.createDataFrame([("s", {"a": True, "b": False}), ("s", {"a": True, "b": True}), ("t", {"a": True})], "style string, checks map<string,boolean>")
    got = {(r.style, r.check): (r.cases, r.passed) for r in validation.pass_rates(cases, "style", "checks").collect()}
    assert got == {("s", "a"): (2, 2), ("s", "b"): (2, 1), ("t", "a"): (1, 1), ("s", None): (2, 1), ("t", None): (1, 1), (None, None): (3, 2)}
    rows = spark.createDataFrame([("take twenty drops daily", "how?", "take twenty drops daily"), ("how?", "how?", "take twenty drops daily")], "g string, s string, a string")
    assert [r.leaks for r in validation.answer_leak(rows, "g", "s", "a").collect()] == [True, False]


def test_mappings(spark):
    ddl = "q string, allowed array<string>, m array<struct<source_phrase:string,source_start:int,source_end:int,canonical_term:string,confidence:double>>"
    rows = spark.createDataFrame([("my head aches", ["ache"], [("head  aches", -1, -1, "ache", 0.9), ("no", 0, 99, "ache", 0.9), ("aches", 8, 13, "other", 0.9), ("aches", 8, 13, "ache", 0.5)])], ddl)
    got = rows.select(validation.mappings_grounded(F.col("m"), F.col("q"), F.col("allowed")).alias("k")).first().k
    assert [x.source_phrase for x in got] == ["head  aches"]
