"""Seeds for new cases: apart from earlier ones, balanced over sources and directions, and dealt to styles.

Whether a seed is too similar to an earlier case is a semi-join on shared terms
that tests the pair in place, so no list of pairs is made. Either set may be the
smaller: an overlap of ``CONTAINED`` of the smaller one must show among its
rarest terms, so those of each side meet all terms of the other, and no pair is
lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.hashing import salted_hash
from tessella.functions.text import grams_of
from tessella.operators.neighbours import running_totals
from tessella.session import materialize

#: Shares of all terms, and of the smaller set's, from which two signatures are too similar, and the least overlap.
SIMILAR, CONTAINED, LEAST = 0.72, 0.85, 2


def too_similar(a: Column, b: Column) -> Column:
    """Whether two sets (arrays of distinct terms) are so much alike that one of them should go."""
    shared, size = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return (shared >= LEAST) & ((shared / size >= SIMILAR) | (shared / F.least(F.size(a), F.size(b)) >= CONTAINED))


def _coded(rows: DataFrame, rank: DataFrame) -> DataFrame:
    """(row, signature): every set as the numbers of its terms, the rarest first."""
    each = rows.select("row", F.explode("signature").alias("term")).join(rank, "term")
    # The terms of a set are bounded by its text.
    return each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", "code"))).alias("t")).select("row", F.col("t.code").alias("signature"))


def _postings(coded: DataFrame, short: bool) -> DataFrame:
    """(row, signature, code): every term of every set, or of its rarest terms as many as an overlap cannot miss."""
    size = F.size("signature")
    # A similarity of SIMILAR implies an overlap of that share of the smaller set too; the lesser bound counts.
    keep = size - F.ceil(F.lit(min(SIMILAR, CONTAINED)) * size).cast("int") + 1
    return coded.select("row", "signature", F.explode(F.slice("signature", F.lit(1), keep) if short else F.col("signature")).alias("code"))


def unlike(seeds: DataFrame, used: DataFrame, key: str, signature: str) -> DataFrame:
    """The seeds that are too similar to none of ``used``; null and empty signatures are similar to nothing, rows that repeat a key stay or go together.

    A set stands at each of its terms, so a table that is small as a file is
    large in memory: sets go as numbers, and postings are merged, never broadcast.
    """
    clean = lambda rows: rows.select(F.col(key).alias("key"), F.array_distinct(F.array_compact(F.col(signature))).alias("signature")).where(F.size("signature") >= LEAST)
    named = lambda rows, name: materialize(rows.withColumn("row", F.monotonically_increasing_id()), name)
    own, old = named(clean(seeds), "seeds"), named(clean(used).select("signature").distinct(), "used")
    counts = own.select("signature").unionByName(old.select("signature")).select(F.explode("signature").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    rank = materialize(counts.withColumn("code", F.monotonically_increasing_id()), "rank").hint("merge")
    mine, theirs = materialize(_coded(own, rank), "coded"), materialize(_coded(old, rank), "coded")
    found = None
    for short in (True, False):
        right = _postings(theirs, not short).select(F.col("signature").alias("old"), F.col("code").alias("old_code"))
        hit = _postings(mine, short).join(right.hint("merge"), (F.col("code") == F.col("old_code")) & too_similar(F.col("signature"), F.col("old")), "left_semi").select("row")
        found = hit if found is None else found.unionByName(hit)
    gone = own.join(found.distinct(), "row", "left_semi").select(F.col("key").alias(key)).distinct()
    return seeds.join(gone, key, "left_anti")


def balanced(rows: DataFrame, source: str, direction: str, quality: str, key: str, quota: int, salt: str = "balance") -> DataFrame:
    """``quota`` rows of each source, its directions as even as their rows allow: always the direction with the fewest so far, of these the best row.

    That is a deal by rounds: round r holds the r-th best row of each
    direction, whole rounds are taken as long as they fit, and of the next the
    best rows. Only rows within the quota are ranked across tasks. A source
    with fewer rows than the quota gives all it has.
    """
    order = [F.desc(quality), salted_hash(salt, F.col(key)), F.col(key)]
    ranked = rows.withColumn("round", F.row_number().over(Window.partitionBy(source, direction).orderBy(*order))).where(F.col("round") <= quota)
    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy(source).orderBy("round", *order)))
    return placed.where(F.col("place") <= quota).drop("place")


def dealt_styles(rows: DataFrame, cells: list[str], key: str, quotas: dict[str, int], salt: str = "style") -> DataFrame:
    """``rows`` with ``style``, dealt in turn: over all rows, and within each cell, styles get their shares to within one row.

    Rows are numbered cell by cell, in each by hash; a style gets the numbers
    that fall to it in a cycle through the quotas. Numbers are running sums by
    range, so no task holds all rows.
    """
    # The cycle spreads each style evenly: slot i of a style's q stands at (i + 1/2) / q.
    slots = [style for _, _, style in sorted(((i + 0.5) / q, n, style) for n, (style, q) in enumerate(quotas.items()) for i in range(q))]
    one = rows.withColumn("_one", F.lit(1).cast("long")).withColumn("_all", F.lit(0)).withColumn("_hash", salted_hash(salt, F.col(key)))
    numbered = running_totals(one, ["_all"], [*cells, "_hash", key], {"_n": "_one"})
    style = F.element_at(F.array(*map(F.lit, slots)), ((F.col("_n") - 1) % len(slots) + 1).cast("int"))
    return numbered.select(*rows.columns, style.alias("style"))


def check_seeds(seeds: DataFrame, quotas: dict[str, int], least_sources: int = 2) -> DataFrame:
    """(style, rows, sources, leaks, repeats, problems): what is wrong with the seeds of each style.

    ``seeds``: style, source, concept, answer, question, key. A leak is a question
    that holds ten characters of its answer in a row; a repeat shares its concept
    with another seed of any style; styles without seeds are reported too.
    """
    leak = F.arrays_overlap(*[grams_of(F.coalesce(c, F.lit("")), 10) for c in ("question", "answer")])
    twice = seeds.groupBy("concept").agg(F.count("*").alias("n")).where("n > 1 and concept is not null").select("concept", F.lit(1).alias("again"))
    found = seeds.withColumn("leak", F.coalesce(leak, F.lit(False)).cast("long")).join(twice, "concept", "left")
    found = found.groupBy("style").agg(F.count("*").alias("rows"), F.countDistinct("source").alias("sources"), F.sum("leak").alias("leaks"), F.sum(F.coalesce("again", F.lit(0))).cast("long").alias("repeats"))
    wanted = seeds.sparkSession.createDataFrame(list(quotas.items()), "style string, quota long")
    all_ = F.broadcast(wanted).join(found, "style", "full_outer").fillna(0, ["rows", "sources", "leaks", "repeats"])
    tests = [("quota", F.coalesce("quota", F.lit(0)) != F.col("rows")), ("sources", F.col("sources") < least_sources), ("leak", F.col("leaks") > 0), ("repeat", F.col("repeats") > 0)]
    return all_.select("style", "rows", "sources", "leaks", "repeats", F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests])), ",").alias("problems"))
