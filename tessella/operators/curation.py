"""Checks, counts and selections over records; every function takes and returns DataFrames or Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import grams_of


def first_rows(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows in ``order``, with ``rank``; the limit holds before the window, so one task sees ``k`` rows."""
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse_terms(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """(term, score, rank) of ranked lists (term, rank): reciprocal ranks summed, 8 digits, ties to the greater term."""
    every = reduce(DataFrame.unionByName, [x.select("term", "rank") for x in lists])
    fused = every.where("term <> ''").groupBy("term").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 8).alias("score"))
    return first_rows(fused, [F.desc("score"), F.desc("term")], k).withColumn("rank", F.col("rank").cast("long"))


def richness(groups: Column, differential: Column, diagnostic: Column, forbidden: Column) -> Column:
    """How much an entry says: 5 a group, 2 a differential, 1 a diagnostic, 3 a forbidden term."""
    return 5 * F.size(groups) + 2 * F.size(differential) + F.size(diagnostic) + 3 * F.size(forbidden)


def rerank_report(ranked: DataFrame, expected: Column) -> DataFrame:
    """One row: what the new order (``rank`` to ``new_rank``) does to expected rows, and how often the new first covers fewer groups than the old."""
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    firsts = ranked.groupBy("query").agg(F.max(F.when(F.col("new_rank") == 1, F.col("group_coverage"))).alias("now"), F.max(F.when(F.col("rank") == 1, F.col("group_coverage"))).alias("before"))
    moved = ranked.where(expected).agg(
        F.count("*").alias("cases"), one(F.col("new_rank") < F.col("rank")).alias("improved"), one(F.col("new_rank") > F.col("rank")).alias("worsened"), one(F.col("new_rank") == F.col("rank")).alias("unchanged")
    )
    return moved.withColumn("boundary_violations", firsts.agg(one(F.col("now") < F.col("before"))).scalar())


def coverage(files: DataFrame, rows: DataFrame, by: str, name: str) -> DataFrame:
    """``files`` with the number of ``rows`` of each, 0 where there are none."""
    counts = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias(name))
    return files.join(counts, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by").withColumn(name, F.coalesce(name, F.lit(0)))


def queue(rows: DataFrame, score: str, least: int, medium: int, high: int) -> DataFrame:
    """Rows whose score reaches ``least``, with their priority."""
    return rows.where(F.col(score) >= least).withColumn("priority", F.when(F.col(score) >= high, "high").when(F.col(score) >= medium, "medium").otherwise("low"))


def marker_counts(rows: DataFrame, text: str, markers: dict[str, str], unit: str) -> DataFrame:
    """(marker, hits, rows with it) for each pattern."""
    each = F.array(*[F.struct(F.lit(k).alias("marker"), F.coalesce(F.regexp_count(text, F.lit(v)), F.lit(0)).alias("n")) for k, v in markers.items()])
    return rows.select(F.explode(each).alias("m")).groupBy("m.marker").agg(F.sum("m.n").alias("hits"), F.sum((F.col("m.n") > 0).cast("int")).alias(unit))


def integrity(records: DataFrame, pairs: DataFrame, labels: DataFrame, residual: dict[str, str]) -> DataFrame:
    """(rule, n): offenders against fourteen rules over records (id, text, role, partition, hash, key), pairs (id, question, answer) and labels (id, label)."""
    count = lambda rows, rule: rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    broken = {
        "partition_mismatch": F.col("role") != F.col("partition"), "missing_id": F.col("id").isNull(), "bad_hash": ~F.col("hash").rlike("^[0-9a-f]{64}$"), "missing_text": F.coalesce("text", F.lit("")) == "",
        **{f"residual_{k}": F.col("text").rlike(p) for k, p in residual.items()},
    }
    # One scan for the rules on single records.
    sums = records.agg(*[F.count(F.when(c, 1)).alias(rule) for rule, c in broken.items()])
    single = sums.select(F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("n")) for rule in broken])).alias("r")).select("r.*")
    leak = F.arrays_overlap(*[grams_of(F.coalesce(c, F.lit("")), 10) for c in ("question", "answer")])
    found = [
        single, count(records.where("id is not null").groupBy("id").count().where("count > 1"), "duplicate_id"),
        count(records.where("key <> ''").groupBy(F.sha2("key", 256)).agg(F.min("partition").alias("a"), F.max("partition").alias("b")).where("a <> b"), "cross_partition_key"),
        count(pairs.groupBy("id").count().where("count > 1"), "duplicate_pair_id"), count(pairs.where(F.coalesce(F.trim("answer"), F.lit("")) == ""), "empty_answer"), count(pairs.where(leak), "answer_leakage"),
        count(labels.where("id is not null").join(records.select("id"), "id", "left_anti"), "orphan_label"), count(labels.groupBy("id").agg(F.countDistinct("label").alias("n")).where("n > 1"), "conflicting_label"),
    ]
    return reduce(DataFrame.unionByName, found)


def align(reports: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, one rank a report, same): the cases that all reports have, side by side."""
    frames = [df.select(key, F.col("rank").alias(name)) for name, df in reports.items()]
    out = reduce(lambda a, b: a.join(b, key), frames)
    first, *rest = (F.col(n) for n in reports)
    return out.withColumn("same", reduce(lambda a, b: a & b, [first.eqNullSafe(r) for r in rest], F.lit(True)))


def inferred(text: Column, keywords: dict[str, list[str]], hits: Column, weight: int = 3) -> Column:
    """array<struct<kind, score, evidence>> of kinds that score: ``weight`` a keyword in the text, 1 a hit; best first, then by name."""
    def one(kind: str, words: list[str]) -> Column:
        found = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
        own = F.size(F.filter(hits, lambda h: h == kind))
        return F.struct((-(weight * F.size(found) + own)).alias("order"), F.lit(kind).alias("kind"), (weight * F.size(found) + own).alias("score"), F.slice(F.array_sort(found), 1, 12).alias("evidence"))

    scored = F.array_sort(F.array(*[one(k, w) for k, w in keywords.items()]))
    return F.transform(F.filter(scored, lambda s: s["score"] > 0), lambda s: F.struct(s["kind"].alias("kind"), s["score"].alias("score"), s["evidence"].alias("evidence")))


def roles(rows: DataFrame, term: str, role: str, place: str, entry: str) -> DataFrame:
    """(term, first, roles): the entry at the first place and all roles, sorted."""
    return rows.groupBy(term).agg(F.min_by(entry, place).alias("first"), F.array_join(F.array_sort(F.collect_set(role)), ",").alias("roles"))


def useful_pairs(rows: DataFrame, key: str, question: int, answer: int, idle: str, keyword: str) -> DataFrame:
    """Pairs long enough, whose answer does not open idly and whose question has a keyword; of equal pairs the least key. Texts are compared by digest."""
    good = rows.where((F.length("question") >= question) & (F.length("answer") >= answer) & ~F.col("answer").rlike(idle) & F.col("question").rlike(keyword))
    return good.groupBy(F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5")).agg(F.min(key).alias(key))


def manifest_status(listed: DataFrame, present: DataFrame, key: str, valid: Column) -> DataFrame:
    """(status, n): listed rows that are missing, invalid or read."""
    own = listed.join(present.select(F.col(key), F.lit(True).alias("_there")), key, "left")
    status = F.when(F.col("_there").isNull(), "missing").when(~valid, "invalid").otherwise("read")
    return own.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def candidate_terms(rows: DataFrame, query: str, rank: str, terms: str, limit: int, most: int = 16) -> DataFrame:
    """(query, terms): terms of ranked rows in order, each at its first place, ``limit`` at most."""
    each = rows.select(F.col(query).alias("query"), F.col(rank).alias("r"), F.posexplode(terms).alias("place", "term")).where(F.length("term").between(2, most))
    first = each.groupBy("query", "term").agg(F.min(F.struct("r", "place")).alias("at"))
    kept = first.withColumn("x", F.row_number().over(Window.partitionBy("query").orderBy("at"))).where(F.col("x") <= limit)
    return kept.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("x", "term"))).alias("t")).select("query", F.col("t.term").alias("terms"))


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, kind, n_rows) of every column."""
    def one(name: str, rows: DataFrame) -> DataFrame:
        fields = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("kind")) for f in rows.schema.fields])
        return rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), F.explode(fields).alias("f"), "n_rows").select("table_name", "f.*", "n_rows")

    return reduce(DataFrame.unionByName, [one(n, t) for n, t in tables.items()])


def public_private(rows: DataFrame, public: list[str]) -> tuple[DataFrame, DataFrame]:
    """The public columns, and all of them."""
    return rows.select(*public), rows


def unsafe_answers(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """Rows that were answered though they should not have been."""
    return rows.where(~F.col(expected) & F.col(actual))


def reject(rows: DataFrame, text: str, pattern: str, message: str) -> DataFrame:
    """``rows``; one whose text has the pattern fails the query."""
    return rows.withColumn(text, F.when(F.col(text).rlike(pattern), F.raise_error(F.lit(message)).cast("string")).otherwise(F.col(text)))
