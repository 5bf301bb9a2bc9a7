"""Connected components of an edge list, by rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import drop_scratch, materialize


def _fold(edges: DataFrame) -> DataFrame:
    """One round of large-star, then small-star. No neighbourhood is ever collected: each step is a minimum by key
    (combined before the shuffle) and an equi-join that adaptive execution may split where a hub is hot."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    large = large.where("src <> dst").distinct()
    # Here every dst is below its src.
    least = large.groupBy("src").agg(F.min("dst").alias("low"))
    small = large.join(least, "src").select(F.explode(F.array(F.struct("src", F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))).alias("e"))
    return small.select("e.src", "e.dst").where("src <> dst").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is the smallest node that can be reached.

    Nodes are integers. Null ends, loops and repeated edges are ignored; an
    empty edge list gives no rows. Every round is written to the shared
    folder, so lineage stays short and lost executors cost one round.
    """
    pairs = edges.select(F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst"))
    # greatest and least skip nulls, so an edge with a null end becomes a loop.
    now = materialize(pairs.where("src is not null and src <> dst").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        nxt = materialize(_fold(now), "edges")
        drop_scratch(now)
        now = nxt
        state = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
