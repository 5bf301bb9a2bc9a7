"""Making and scoring cases: signatures, term indexes, review rows, seeds, samples and candidate questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covers_signature(groups: Column, asked: Column, held: Column, negated: Column) -> Column:
    """Whether every group meets both the query and what was matched, and nothing is negated; no groups are no signature."""
    met = F.forall(groups, lambda g: F.arrays_overlap(g, asked) & F.arrays_overlap(g, held))
    return F.coalesce((F.size(groups) > 0) & met & (F.size(negated) == 0), F.lit(False))


def term_index(entries: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(term, key, field): where each term stands; a term once a field."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.array().cast("array<string>")).alias("terms")) for f in fields]))
    return entries.select(F.col(key).alias("key"), each.alias("f")).select("key", "f.field", F.explode("f.terms").alias("term")).distinct().select("term", "key", "field")


def compact_hits(index: DataFrame, asked: DataFrame, limit: int = 30) -> DataFrame:
    """(query, key, field, term): one hit (the least term) for each entry and field, ``limit`` a query by entry and field. ``asked``: query, term."""
    first = index.join(asked.distinct(), "term").groupBy("query", "key", "field").agg(F.min("term").alias("term"))
    return first.withColumn("x", F.row_number().over(Window.partitionBy("query").orderBy("key", "field"))).where(F.col("x") <= limit).drop("x")


def review_rows(terms: DataFrame, term: str, entries: str, long: int, broad: int) -> DataFrame:
    """(id, term, priority, flags): rows for a reviewer."""
    flags = F.array_compact(F.array(F.when(F.length(term) >= long, "long"), F.when(F.col(entries) > broad, "broad"), F.when(F.col(term).rlike("[0-9]"), "digits")))
    priority = F.when(F.col(entries) > broad, "low").when(F.length(term) >= long, "high").otherwise("medium")
    return terms.select(F.left(F.sha2(term, 256), F.lit(16)).alias("id"), F.col(term).alias("term"), priority.alias("priority"), F.array_join(flags, ",").alias("flags"))


def concept_key(terms: Column) -> Column:
    """The same for the same set of terms."""
    return F.array_join(F.array_sort(F.array_distinct(terms)), "|")


def seed_groups(required: Column, diagnostic: Column, most: int = 4) -> Column:
    """Up to ``most`` groups: the required ones, then each diagnostic term that no group holds, by itself."""
    single = F.transform(F.array_except(F.coalesce(diagnostic, F.array().cast("array<string>")), F.flatten(required)), lambda t: F.array(t))
    return F.slice(F.concat(required, single), 1, most)


def unused(seeds: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Seeds whose concept no earlier case has; of equal ones the first by ``key``."""
    fresh = seeds.join(used.select("concept").distinct(), "concept", "left_anti")
    return fresh.withColumn("x", F.row_number().over(Window.partitionBy("concept").orderBy(key))).where("x = 1").drop("x")


def first_samples(rows: DataFrame, by: str, order: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(by, one column a pattern): where the first row with each pattern stands, or null."""
    return rows.groupBy(by).agg(*[F.min(F.when(F.col(text).rlike(p), F.col(order))).alias(name) for name, p in patterns.items()])


def candidate_stream(rows: DataFrame, key: str, text: Column, normal: Column, rejects: list[str], least: int = 8, most: int = 300) -> DataFrame:
    """(key, hash): texts of ``least`` to ``most`` characters without a rejected pattern, each normalised text once, under its least key."""
    good = rows.select(F.col(key).alias("key"), text.alias("t"), normal.alias("norm")).where(F.length("t").between(least, most) & (F.col("norm") != ""))
    for pattern in rejects:
        good = good.where(~F.col("t").rlike(pattern))
    return good.groupBy(F.sha2("norm", 256).alias("hash")).agg(F.min("key").alias("key"))


def dataset_rows(pairs: DataFrame, key: str) -> DataFrame:
    """(id, kind, text_md5): a pair of questions gives each question, and itself; empty ones are left out."""
    one = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    made = F.array(one("question", F.col("question")), one("question", F.col("answer")), one("pair", F.concat_ws("\t", "question", "answer")))
    return pairs.select(F.col(key).alias("id"), F.posexplode(made).alias("place", "m")).where(F.trim(F.coalesce("m.text", F.lit(""))) != "").select("id", "place", "m.kind", F.md5("m.text").alias("text_md5"))


def confusions(pairs: DataFrame, wrong: str, right: str) -> DataFrame:
    """(place, a, b, n): characters that stand for others at the same place in texts of one length."""
    same = pairs.where((F.length(wrong) == F.length(right)) & (F.col(wrong) != F.col(right)))
    zipped = F.arrays_zip(F.split(wrong, "").alias("a"), F.split(right, "").alias("b"))
    each = same.select(F.posexplode(zipped).alias("place", "z")).where("z.a <> z.b and z.a <> ''")
    return each.groupBy("place", "z.a", "z.b").agg(F.count("*").alias("n"))
