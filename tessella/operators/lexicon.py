"""Dictionary matching in texts by equi-joins on n-grams, and overlap resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import let


def match_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, term, start): every occurrence of every term, start from 1.

    ``terms`` has ``term``, and ``sizes`` the lengths that occur in it: grams
    of just those lengths are joined to the terms, instead of pairing every
    text with every term.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def grams(chars: Column, n: int) -> Column:
        heads = F.slice(chars, F.lit(1), F.greatest(F.lit(0), F.size(chars) - (n - 1)))
        return F.transform(heads, lambda c, i: F.struct(F.array_join(F.slice(chars, i + 1, F.lit(n)), "").alias("term"), (i + 1).alias("start")))

    every = let(F.filter(F.split(body, ""), lambda c: c != ""), lambda chars: F.concat(*[grams(chars, n) for n in sizes]))
    each = texts.select(F.col(key).alias("key"), F.explode(every).alias("g")).select("key", "g.term", "g.start")
    return each.join(terms.select("term").distinct(), "term").select("key", "term", "start")


def match_words(texts: DataFrame, key: str, words: Column, terms: DataFrame) -> DataFrame:
    """(key, term, place): the words of a text that are terms, place from 0."""
    each = texts.select(F.col(key).alias("key"), F.posexplode(words).alias("place", "term"))
    return each.join(terms.select("term").distinct(), "term").select("key", "term", "place")


def non_overlapping(hits: DataFrame, longest_first: bool = True, later_wins: bool = False) -> DataFrame:
    """(key, chosen array<struct<start, term>>): greedy choice without overlaps, in order of start.

    Longest terms are chosen first; ties go to the earlier start, or with
    ``later_wins`` to the later one. Without ``longest_first`` the leftmost
    hit is chosen first, the longest of one start before the others.
    """
    size = lambda s: F.length(s["term"])
    hit = F.struct(F.col("start").cast("int").alias("start"), F.col("term").alias("term"))
    grouped = hits.groupBy("key").agg(F.collect_set(hit).alias("hits"))

    def compare(a: Column, b: Column) -> Column:
        by_size = F.when(size(a) > size(b), -1).when(size(a) < size(b), 1)
        early, late = (1, -1) if later_wins else (-1, 1)
        by_start = F.when(a["start"] < b["start"], early).when(a["start"] > b["start"], late)
        by_term = F.when(a["term"] < b["term"], -1).when(a["term"] > b["term"], 1).otherwise(0)
        return F.coalesce(by_size, by_start, by_term) if longest_first else F.coalesce(by_start, by_size, by_term)

    ends = lambda s: s["start"] + size(s)
    free = lambda acc, x: ~F.exists(acc, lambda c: (c["start"] < ends(x)) & (x["start"] < ends(c)))
    none = F.array().cast("array<struct<start:int,term:string>>")
    chosen = F.aggregate(F.array_sort("hits", compare), none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return grouped.select("key", F.array_sort(chosen).alias("chosen"))


def similar_entries(postings: DataFrame, k: int | None = 5, least: float = 0.08, other_names: bool = True) -> DataFrame:
    """(a, b, shared, jaccard, rank): entries that share terms but not their name, the best k of each.

    Without ``k`` all of them, without the rank; without ``other_names`` those of one name too.

    ``postings``: key, term, kind, name, n_terms. Pairs arise only where a
    term is shared; catalogue terms are rare by construction (a bounded
    document frequency), which bounds each term's pairs.
    """
    from tessella.operators.retrieval import top_k

    left = postings.select(F.col("key").alias("a"), "term", "kind", F.col("name").alias("name_a"), F.col("n_terms").alias("n_a"))
    right = postings.select(F.col("key").alias("b"), "term", "kind", F.col("name").alias("name_b"), F.col("n_terms").alias("n_b"))
    pairs = left.join(right, ["term", "kind"]).where("a <> b and name_a <> name_b" if other_names else "a <> b").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    scored = pairs.withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).where(F.col("jaccard") >= least)
    if k is None:
        return scored.select("a", "b", "shared", "jaccard")
    return top_k(scored, ["a"], [F.desc("jaccard"), F.asc("b")], k).select("a", "b", "shared", "jaccard", "rank")
