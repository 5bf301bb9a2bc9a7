"""Leakage-safe splits, quotas and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.hashing import salted_hash, stable_split
from tessella.operators.graph import connected_components
from tessella.session import materialize


def term_holdout(rows: DataFrame, terms: str, fraction: float = 0.15, seed: str = "holdout") -> DataFrame:
    """``split``: dev or train if all terms of a row are on one side, else excluded (as are rows without terms)."""
    dev = F.size(F.filter(terms, lambda t: stable_split(t, fraction, seed) == "dev"))
    n = F.size(terms)
    return rows.withColumn("split", F.when(n <= 0, "excluded").when(dev == n, "dev").when(dev == 0, "train").otherwise("excluded"))


def component_split(pairs: DataFrame, a: str, b: str, fraction: float = 0.15, seed: str = "pairs") -> DataFrame:
    """(node, component, split): whole components go to one side."""
    parts = connected_components(pairs, a, b)
    return parts.withColumn("split", stable_split(F.col("component"), fraction, seed))


def quota_sample(rows: DataFrame, stratum: str, key: str, quota: int, salt: str = "quota") -> DataFrame:
    """The first ``quota`` rows of each stratum by salted hash."""
    order = Window.partitionBy(stratum).orderBy(salted_hash(salt, F.col(key)), F.col(key))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota)


def pool(rows: DataFrame, category: str, score: Column, key: str, quota: int) -> DataFrame:
    """The best ``quota`` rows of each category; ties by hash."""
    order = Window.partitionBy(category).orderBy(score.desc(), salted_hash("pool", F.col(key)), F.col(key))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota)


def allocate(rows: DataFrame, key: str, categories: dict[str, Column], quota: int) -> DataFrame:
    """(key, category): categories in order take their best rows; each row goes once."""
    from functools import reduce

    taken: list[DataFrame] = []
    left = rows
    for name, score in categories.items():
        best = left.where(score > 0).orderBy(score.desc(), salted_hash(name, F.col(key)), F.col(key)).limit(quota).select(F.col(key), F.lit(name).alias("category"))
        best = materialize(best, "allocated")  # a quota of rows
        taken.append(best)
        left = left.join(best.select(key), key, "left_anti")
    return reduce(DataFrame.unionByName, taken)


def balance(rows: DataFrame, source: str, direction: str, quality: str, key: str, quota: int) -> DataFrame:
    """``quota`` rows, taken in turn from each (source, direction): the best of each first."""
    place = F.row_number().over(Window.partitionBy(source, direction).orderBy(F.desc(quality), salted_hash("balance", F.col(key)), F.col(key)))
    return rows.withColumn("round", place).where(F.col("round") <= quota).orderBy("round", salted_hash("turn", F.col(key)), key).limit(quota)


def upsert(base: DataFrame, patch: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of ``patch`` replace those of ``base`` with their key and keep their position; new ones follow."""
    last = base.agg(F.coalesce(F.max(position), F.lit(0)))
    both = base.withColumn("_pri", F.lit(0)).unionByName(patch.withColumn("_pri", F.lit(1)).withColumn(position, F.col(position) + last.scalar()))
    own = Window.partitionBy(key)
    ranked = both.withColumn("_r", F.row_number().over(own.orderBy(F.desc("_pri"), F.desc(position)))).withColumn("_p", F.min(position).over(own))
    return ranked.where("_r = 1").withColumn(position, F.col("_p")).drop("_pri", "_r", "_p")
