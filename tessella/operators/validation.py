"""Validators of entries, generated cases and dialogues: problem codes as arrays, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(rules: dict[str, Column]) -> Column:
    """Codes of the rules whose condition holds (null counts as not)."""
    return F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(bad, code) for code, bad in rules.items()]))


def required_fields(kind: str, needs: dict[str, list[str]]) -> Column:
    """``missing:<field>`` for each field that the row's kind needs and that is null, empty or an empty array."""
    none = F.lit(None).cast("string")
    gone = lambda c: F.coalesce(F.length(F.array_join(F.flatten(F.array(F.split(F.concat_ws("\x1f", c), "\x1f"))), "")) == 0, F.lit(True))
    checks = [F.when((F.col(kind) == k) & gone(F.col(f)), f"missing:{f}") for k, fields in needs.items() for f in fields]
    return F.array_compact(F.array(none, *checks))


def histogram(rows: DataFrame, codes: str) -> DataFrame:
    """(code, n) over an array of problem codes."""
    return rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def filled(rows: DataFrame, by: str, arrays: list[str]) -> DataFrame:
    """By ``by``: rows, and how many have each array non-empty."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"), *[F.sum(F.when(F.size(a) > 0, 1).otherwise(0)).alias(f"with_{a}") for a in arrays])


def pass_rates(cases: DataFrame, style: str, checks: str) -> DataFrame:
    """(style, check, cases, passed, rate) from a map of checks: by style and check, by style (all checks), and overall."""
    each = cases.select(F.col(style).alias("style"), F.monotonically_increasing_id().alias("id"), F.forall(F.map_values(checks), lambda x: x).alias("whole"), F.explode(checks).alias("check", "ok"))
    by_check = each.groupBy("style", "check").agg(F.count("*").alias("cases"), F.sum(F.col("ok").cast("int")).alias("passed"))
    whole = cases.select(F.col(style).alias("style"), F.forall(F.map_values(checks), lambda x: x).alias("whole"))
    overall = whole.rollup("style").agg(F.count("*").alias("cases"), F.sum(F.col("whole").cast("int")).alias("passed")).select("style", F.lit(None).cast("string").alias("check"), "cases", "passed")
    return by_check.unionByName(overall).withColumn("rate", F.col("passed") / F.col("cases"))


def answer_leak(rows: DataFrame, generated: str, source: str, answer: str, n: int = 10) -> DataFrame:
    """``leaks``: whether the generated text holds an n-character run of the answer that the source does not."""
    from tessella.functions.text import grams_of

    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+", "")
    shared = F.array_intersect(grams_of(flat(generated), n), grams_of(flat(answer), n))
    return rows.withColumn("leaks", F.size(F.array_except(shared, grams_of(flat(source), n))) > 0)


def mappings_grounded(mappings: Column, query: Column, allowed: Column, least: float = 0.72) -> Column:
    """Of array<struct<source_phrase, source_start, source_end, canonical_term, confidence>>: those whose phrase stands in
    the query (white space apart, or by valid half-open offsets), whose term is allowed and whose confidence suffices."""
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")

    def ok(m: Column) -> Column:
        said = F.contains(squeeze(query), squeeze(m["source_phrase"])) & (F.length(squeeze(m["source_phrase"])) > 0)
        placed = (m["source_start"] >= 0) & (m["source_end"] > m["source_start"]) & (m["source_end"] <= F.length(query))
        return (said | placed) & F.array_contains(allowed, m["canonical_term"]) & (m["confidence"] >= least)

    return F.filter(mappings, ok)
