"""Ranking quality, pass rates, percentiles and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import grams_of
from tessella.operators.neighbours import running_total


def ranking(cases: DataFrame, rank: str, cutoffs: tuple[int, ...] = (1, 5, 8), depth: int = 8) -> DataFrame:
    """recall@k, MRR and nDCG over cases whose ``rank`` is null when nothing was found."""
    r = F.col(rank)
    inside = r <= depth
    return cases.agg(
        F.count("*").alias("cases"), *[F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in cutoffs],
        F.avg(F.when(inside, 1.0 / r).otherwise(0.0)).alias("mrr"), F.avg(F.when(inside, 1.0 / F.log2(r + 1.0)).otherwise(0.0)).alias("ndcg"),
    )


def group_recall(cases: DataFrame, groups: str, predictions: str, cutoffs: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """MRR, and by cutoff: share of synonym groups hit, cases with all hit, cases with any."""
    first = lambda g: F.array_min(F.filter(F.transform(g, lambda t: F.array_position(predictions, t)), lambda p: p > 0))
    ranks = cases.select(F.transform(groups, first).alias("ranks"))
    hits = lambda k: F.size(F.filter("ranks", lambda x: x <= k))
    total = F.sum(F.size("ranks"))
    out = [F.count("*").alias("cases"), F.avg(F.coalesce(1.0 / F.array_min(F.filter("ranks", lambda x: x.isNotNull())), F.lit(0.0))).alias("mrr")]
    for k in cutoffs:
        out += [
            (F.sum(hits(k)) / total).alias(f"group_recall_{k}"), F.avg(F.when((F.size("ranks") > 0) & (hits(k) == F.size("ranks")), 1.0).otherwise(0.0)).alias(f"case_all_{k}"),
            F.avg(F.when(hits(k) > 0, 1.0).otherwise(0.0)).alias(f"case_any_{k}"),
        ]
    return ranks.agg(*out)


def percentiles(rows: DataFrame, value: str, q: float = 0.95, by: str | None = None) -> DataFrame:
    """Three definitions: place ceil(nq) - 1, round((n - 1)q) and int(nq), each within the sorted values.

    The places are found by a running count over distinct values, in ranges of
    them, so no group is gathered in one row or task.
    """
    keys = [by] if by else []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    run = running_total(counts, keys, ["v"], "c", "upto")
    sizes = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    run = run.join(sizes.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by") if by else run.withColumn("n", sizes.scalar())
    at = {"p_ceil": F.greatest(F.ceil(F.col("n") * q) - 1, F.lit(0)), "p_round": F.bround((F.col("n") - 1) * q, 0).cast("long"), "p_int": F.least((F.col("n") * q).cast("long"), F.col("n") - 1)}
    return run.groupBy(*keys).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > place, F.col("v"))).alias(name) for name, place in at.items()])


def compare(a: DataFrame, b: DataFrame, key: str, rank: str = "rank", missing: int = 999) -> DataFrame:
    """Of two runs over the same cases: gained, lost, improved, worsened, unchanged."""
    both = a.select(key, F.coalesce(rank, F.lit(missing)).alias("ra")).join(b.select(key, F.coalesce(rank, F.lit(missing)).alias("rb")), key, "full")
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    ra, rb = F.coalesce("ra", F.lit(missing)), F.coalesce("rb", F.lit(missing))
    return both.select(ra.alias("ra"), rb.alias("rb")).agg(
        F.count("*").alias("cases"), one((F.col("rb") == 1) & (F.col("ra") != 1)).alias("gained"), one((F.col("ra") == 1) & (F.col("rb") != 1)).alias("lost"),
        one(F.col("rb") < F.col("ra")).alias("improved"), one(F.col("rb") > F.col("ra")).alias("worsened"), one(F.col("rb") == F.col("ra")).alias("unchanged"),
    )


def bigrams(text: Column) -> Column:
    """Character bigrams (repeats kept) of a text without blanks, lower-cased."""
    return grams_of(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", ""), 2)


def bigram_f1(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, f1): overlap of two texts' bigram multisets."""
    side = lambda c, name: rows.select(F.col(key).alias("key"), F.explode(bigrams(F.col(c))).alias("gram")).groupBy("key", "gram").agg(F.count("*").alias(name))
    both = side(a, "na").join(side(b, "nb"), ["key", "gram"], "full")
    sums = both.groupBy("key").agg(F.sum(F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))).alias("shared"), F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    return sums.select("key", (2 * F.col("shared") / (F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0)))).alias("f1"))
