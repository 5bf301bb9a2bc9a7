"""The row before each row of its group, and running totals, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize


def previous(rows: DataFrame, by: str, order: str, bring: list[str]) -> DataFrame:
    """``rows`` with ``prev_<column>`` of the row before it in ascending ``order`` within ``by``; null for the first.

    Rows are dealt out by range of (by, order); a window runs inside each
    range, and a range's first row takes the last of its group in an earlier
    range, one row a range and group at most. Null groups are a group of
    their own; equal ``order`` makes the row before arbitrary.
    """
    spread = materialize(rows.repartitionByRange(by, order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = F.struct(*bring)
    inside = Window.partitionBy("_part", by).orderBy(order)
    placed = spread.withColumn("_prev", F.lag(own).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    # One row a range and group: (ranges + groups) rows at most, as groups lie in neighbouring ranges.
    tails = spread.groupBy("_part", by).agg(F.max_by(own, order).alias("_tail"))
    ends = tails.withColumn("_tail", F.lag("_tail").over(Window.partitionBy(by).orderBy("_part"))).select(F.col("_part").alias("_p"), F.col(by).alias("_by"), "_tail")
    joined = placed.join(ends, F.col("_first") & (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_by")), "left")
    found = F.coalesce("_prev", "_tail")
    return joined.select(*rows.columns, *[found[c].alias(f"prev_{c}") for c in bring])


def running_total(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of its group up to and with this one, in ascending ``order``."""
    return running_totals(rows, by, order, {name: value})


def running_totals(rows: DataFrame, by: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """``rows`` with, for each name of ``values``, the sum of that column over the rows of its group up to and with this one, in ascending ``order``.

    Exact whatever the ranges: a window runs inside each range of (by, order),
    and ranges add what their groups hold in earlier ones. Rows that agree in
    ``order`` follow each other in an arbitrary order.
    """
    spread = materialize(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = spread.groupBy("_part", *by).agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in values.items()])
    # One row a range and group: (ranges + groups) rows at most, as groups lie in neighbouring ranges.
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = [F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_start_{k}") for k in values]
    starts = sums.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], *starts)
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    runs = spread.select("*", *[F.sum(v).over(inside).alias(f"_run_{k}") for k, v in values.items()])
    return runs.join(starts, same).select(*rows.columns, *[(F.col(f"_start_{k}") + F.col(f"_run_{k}")).alias(k) for k in values])
