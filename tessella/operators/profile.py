"""Profiles of JSON, tables and files, and integrity rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_profile(rows: DataFrame, column: str) -> DataFrame:
    """(key, type, n): how often each top-level key of JSON objects has a value of each type."""
    text = F.col(column)
    keys = F.json_object_keys(text)
    each = rows.select(F.explode(F.coalesce(keys, F.array(F.lit("<non_object_record>")))).alias("key"), text.alias("j"))
    raw = F.expr("schema_of_variant(try_variant_get(try_parse_json(j), concat('$[\"', key, '\"]'), 'variant'))")
    kind = F.when(F.col("key") == "<non_object_record>", "other").when(raw.isNull() | (raw == "VOID"), "null").when(raw == "BOOLEAN", "bool").when(raw == "BIGINT", "int").when(raw.rlike("^(DOUBLE|DECIMAL|FLOAT)"), "float").when(raw == "STRING", "str").when(raw.startswith("ARRAY"), "list").otherwise("dict")
    return each.select("key", kind.alias("type")).groupBy("key", "type").agg(F.count("*").alias("n"))


def violations(rules: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(rule, n): rows of each rule's table that its condition picks."""
    each = [df.where(bad).agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n") for name, (df, bad) in rules.items()]
    return reduce(DataFrame.unionByName, each)


def duplicated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256, valid_utf8, replaced): every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid_utf8"), F.regexp_count(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�")).alias("replaced"))


def reconcile(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, n_a, n_b) where two tables' counts differ."""
    count = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    both = count(a, "n_a").join(count(b, "n_b"), by, "full").select(by, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return both.where("n_a <> n_b")


def crawl_integrity(manifest: DataFrame, pages: DataFrame, active: DataFrame, heading: str = r"(?m)^## ") -> DataFrame:
    """(name, problems): what is wrong with each crawled work, and with works that are there though no manifest has them.

    ``manifest``: name, sha256, chapters, status (published or quarantined);
    ``pages``: name, content; ``active``: name, the works in use. Problems are
    missing, hash, chapters, quarantined_but_active, published_but_inactive and
    unlisted; a null hash or count is not checked, repeated names are one.
    """
    stored = pages.groupBy("name").agg(F.min(F.sha2(F.coalesce("content", F.lit("")), 256)).alias("found"), F.min(F.regexp_count(F.coalesce("content", F.lit("")), F.lit(heading))).alias("headings"), F.lit(True).alias("stored"))
    listed = manifest.groupBy("name").agg(F.min("sha256").alias("sha256"), F.min("chapters").alias("chapters"), F.min("status").alias("status"), F.lit(True).alias("listed"))
    used = active.select("name").distinct().withColumn("used", F.lit(True))
    rows = listed.join(stored, "name", "full").join(used, "name", "full")
    held = lambda c: F.coalesce(c, F.lit(False))
    tests = {
        "unlisted": ~held("listed"), "missing": held("listed") & ~held("stored"), "hash": held("stored") & (F.col("found") != F.col("sha256")), "chapters": held("stored") & (F.col("headings") != F.col("chapters")),
        "quarantined_but_active": held("used") & (F.col("status") == "quarantined"), "published_but_inactive": ~held("used") & (F.col("status") == "published"),
    }
    return rows.select("name", F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])), ",").alias("problems"))
