"""Parents and children of Markdown documents: header split, merge of small, split of large, child windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import let, split_headers, windows


def _join_small(pieces: Column, least: int) -> Column:
    """Consecutive pieces until each reaches ``least`` characters; a small tail joins the piece before it."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        text = F.when(acc["open"].isNull(), piece).otherwise(F.concat(acc["open"], F.lit("\n\n"), piece))
        full = F.length(text) >= least
        return F.when(full, F.struct(F.concat(acc["done"], F.array(text)).alias("done"), F.lit(None).cast("string").alias("open"))).otherwise(F.struct(acc["done"].alias("done"), text.alias("open")))

    def close(acc: Column) -> Column:
        n = F.size(acc["done"])
        tail = F.concat(F.element_at(acc["done"], -1), F.lit("\n\n"), acc["open"])
        return F.when(acc["open"].isNull(), acc["done"]).when(n == 0, F.array(acc["open"])).otherwise(F.concat(F.slice(acc["done"], F.lit(1), n - 1), F.array(tail)))

    return F.aggregate(pieces, zero, step, close)


def _split_large(pieces: Column, most: int, overlap: int) -> Column:
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > most, windows(p, most, overlap)).when(F.length(p) > 0, F.array(p)).otherwise(none)))


def parents(docs: DataFrame, key: str, text: str, least: int = 1500, most: int = 3500, overlap: int = 80) -> DataFrame:
    """(key, parent_id, parent): sections by header, small ones merged, large ones split, small remains merged again."""
    chunks = let(F.coalesce(F.col(text), F.lit("")), lambda t: _join_small(_split_large(_join_small(split_headers(t), least), most, overlap), least // 4))
    rows = docs.select(F.col(key).alias("key"), F.posexplode(chunks).alias("i", "parent"))
    return rows.select("key", F.concat(F.col("key").cast("string"), F.lit("_parent_"), F.col("i").cast("string")).alias("parent_id"), "parent")


def children(parent_rows: DataFrame, size: int = 400, overlap: int = 80) -> DataFrame:
    """(key, parent_id, chunk, child): windows of each parent."""
    return parent_rows.select("key", "parent_id", F.posexplode(windows(F.col("parent"), size, overlap)).alias("chunk", "child"))
