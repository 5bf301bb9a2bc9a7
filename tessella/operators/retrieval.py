"""Recall routes, fusion, ranking and diversification over DataFrames."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize


def bm25_index(docs: DataFrame, key: str, tokens: str, asked: DataFrame | None = None) -> DataFrame:
    """Postings (key, token, tf, dl, df, n, avgdl), of the tokens in ``asked`` if that is given; written once.

    Only asked tokens are counted, so what is shuffled grows with the queries.
    The token null stands for the document itself and carries its length.
    """
    whole = docs.select(F.col(key).alias("key"), F.size(tokens).cast("long").alias("dl"), F.explode(F.array_append(F.col(tokens), F.lit(None).cast("string"))).alias("token"))
    if asked is not None:
        wanted = asked.select("token").distinct().unionByName(asked.sparkSession.range(1).select(F.lit(None).cast("string").alias("token"))).select(F.col("token").alias("_t"))
        whole = whole.join(wanted, F.col("token").eqNullSafe(F.col("_t")), "left_semi")
    tf = materialize(whole.groupBy("key", "token", "dl").agg(F.count("*").alias("tf")), "postings")
    totals = tf.where("token is null").agg(F.struct(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl")))
    tf = tf.where("token is not null")
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    return tf.join(df, "token").withColumn("_t", totals.scalar()).select("key", "token", "tf", "dl", "df", "_t.n", "_t.avgdl")


def bm25_scores(index: DataFrame, queries: DataFrame, query: str, tokens: str, k1: float = 1.5, b: float = 0.75, qtf_cap: int = 2) -> DataFrame:
    """(query, key, score) with score > 0: an equi-join on token; a query's repeated tokens count up to ``qtf_cap``."""
    asked = queries.select(F.col(query).alias("query"), F.explode(tokens).alias("token")).groupBy("query", "token").agg(F.least(F.count("*"), F.lit(qtf_cap)).alias("qtf"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) * F.col("qtf")
    return index.join(asked, "token").groupBy("query", "key").agg(F.sum(part).alias("score")).where("score > 0")


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, part: int = 20_000, block: int = 2_000) -> DataFrame:
    """(query, key, score, rank): each query's ``k`` nearest others by cosine, rounded to 6 digits, ties to the smaller key.

    ``vectors`` (key, v) are dealt into parts, ``queries`` (query, qv) into
    blocks; a task multiplies a part by a block and passes on each query's
    best. Vectors of zero length have the score null and come last.
    """
    parts, blocks = (max(1, -(-rows.count() // size)) for rows, size in ((vectors, part), (queries, block)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = vectors.select("key", F.col("v").cast("array<double>").alias("v"), deal("key", parts).alias("part"), every(blocks).alias("block"))
    asked = queries.select("query", F.col("qv").cast("array<double>").alias("qv"), deal("query", blocks).alias("block"), every(parts).alias("part"))

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        left = left.sort_by("key")
        keys, asks = left.column("key").to_numpy(), right.column("query").to_numpy()
        v, q = (np.array(t.column(c).to_pylist(), dtype=float) for t, c in ((left, "v"), (right, "qv")))
        with np.errstate(invalid="ignore", divide="ignore"):
            scores = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
        scores[asks[:, None] == keys[None, :]] = -np.inf
        scores = np.where(np.isnan(scores), -2.0, scores)
        most = min(k + 1, len(keys))
        edge = np.partition(scores, len(keys) - most, axis=1)[:, len(keys) - most]
        row, at = np.nonzero(scores >= edge[:, None])
        order = np.lexsort((at, -scores[row, at], row))
        row, at = row[order], at[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        good = (place < k) & (scores[row, at] > -np.inf)
        row, at = row[good], at[good]
        found = scores[row, at]
        return pa.table({"query": asks[row], "key": keys[at], "score": pa.array(found, mask=found < -1.5)})

    best = own.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(multiply, "query long, key long, score double")
    return top_k(best, ["query"], [F.desc_nulls_last("score"), F.asc("key")], k)


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Ranked rows 1..k of each group; the limit is applied before the shuffle too."""
    from pyspark.sql import Window

    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def overlap_route(postings: DataFrame, queries: DataFrame, query: str, terms: str) -> DataFrame:
    """(query, key, matched, n_matched): entries that share terms with a query, by an equi-join on term."""
    asked = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(terms)).alias("term"))
    hits = postings.join(asked, "term").groupBy("query", "key").agg(F.array_sort(F.collect_set("term")).alias("matched"))
    return hits.withColumn("n_matched", F.size("matched"))


def rrf(routes: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of routes (query, key, rank): score, number of routes and best rank."""
    tagged = [df.select("query", "key", "rank", F.lit(name).alias("route")) for name, df in routes.items()]
    every = reduce(DataFrame.unionByName, tagged)
    return every.groupBy("query", "key").agg(F.sum(1 / (k + F.col("rank"))).alias("rrf_score"), F.count("*").alias("n_routes"), F.min("rank").alias("best_rank"))


def collapse_best(rows: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """The best row of each group (score, then the smaller ``tie``)."""
    return top_k(rows, by, [F.desc(score), F.asc(tie)], 1, "_r").drop("_r")


def diversify(rows: DataFrame, query: str, identity: str, pos: str, prefer: list[Column], limit: int) -> DataFrame:
    """The best of each identity at the place of its first; the rest follow in order; ``limit`` a query.

    ``prefer`` orders the rows of one identity; a preferred row takes the
    place of its identity's first.
    """
    from pyspark.sql import Window

    own = Window.partitionBy(query, identity)
    best = rows.withColumn("_b", F.row_number().over(own.orderBy(*prefer, F.col(pos)))).withColumn("_slot", F.min(pos).over(own))
    lead = F.when(F.col("_b") == 1, 0).otherwise(1)
    place = F.when(F.col("_b") == 1, F.col("_slot")).otherwise(F.col(pos))
    return top_k(best.withColumn("_l", lead).withColumn("_p", place), [query], [F.asc("_l"), F.asc("_p"), F.asc(pos)], limit, "slot").drop("_b", "_slot", "_l", "_p")


def rerank(rows: DataFrame, query: str, pos: str, first: int, keys: list[Column]) -> DataFrame:
    """The first ``first`` candidates in the order of ``keys``; the tail keeps its own."""
    from pyspark.sql import Window

    head = F.col(pos) <= first
    order = [F.when(head, 0).otherwise(1), *[F.when(head, k).desc_nulls_last() for k in keys], F.col(pos)]
    return rows.withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
