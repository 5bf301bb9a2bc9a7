"""Mixing sources to target weights by temperature.

The token share of each source is raised to an exponent and normalised. The
exponent is the smallest in [0, 1] at which the mixture's entropy is at most
``entropy`` of the greatest possible (the logarithm of the number of sources),
and no source is read more than ``max_repeats`` times; it is found by
bisection, ``WAYS`` - 1 cuts of the interval at a time, each round one
aggregate over the table of sources, however many these are. The exponent 1
(natural shares) is taken where even that cannot meet both.

The weights are realised in blocks. With a budget of tokens (``budget`` of all
tokens), a source of weight w gets w of it: as many whole passes as fit, then
part of one more. Every pass is a permutation of the source by a hash of
(seed, source, pass, document), and the last pass is cut where the running sum
of tokens would exceed what is left. That cut is found in two steps, by sums
over slices of the hash range and then inside the one slice that holds it, so
a source with a third of all documents is never in one task; and as the cut
is a value of the hash, each document then decides for itself, where it lies.

A token is a run of characters other than space and \\t to \\r. Defined cases:
a null text has no tokens; a null source is a source of its own; a source
without tokens has weight 0 and is not drawn; rows that repeat a document id
within a source have equal hashes and are drawn together; an empty table
gives an empty mixture; extra columns pass through unless they clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Parts of the interval in a round, and rounds: 32 ** 10 = 2 ** 50.
WAYS, ROUNDS = 32, 10
SLICE = 4096


def count_tokens(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permutation_hash(seed: str, source, block, key):
    """The place of a document in a pass: 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(source, F.lit("")), block.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def exponent_of(sums: DataFrame, entropy: float, max_repeats: float, budget: float) -> tuple[float, float, int]:
    """(exponent, norm, all tokens) from (source, tokens); the driver gets one row of sums a round."""
    whole = sums.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.min("tokens").alias("least")).first()
    if not whole.n:
        return 1.0, 1.0, 0
    share = F.col("tokens") / F.lit(float(whole.tokens))
    rare = whole.least / whole.tokens  # the source read most often, as exponents are at most 1

    def sums_at(exponents: list[float]) -> list[tuple[float, float]]:
        power = [F.pow(share, F.lit(a)) for a in exponents]
        row = sums.agg(*[F.sum(p) for p in power], *[F.sum(p * F.ln(share)) for p in power]).first()
        return list(zip(row[: len(exponents)], row[len(exponents) :]))

    def fits(a: float, norm: float, dot: float) -> bool:
        # With z the sum of p^a: entropy = ln z - a * sum(p^a * ln p) / z; a source of share p is read (budget * p^(a - 1) / z) times.
        return math.log(norm) - a * dot / norm <= entropy * math.log(whole.n) and budget * rare ** (a - 1) / norm <= max_repeats

    low, high = 0.0, 1.0
    if fits(0.0, *sums_at([0.0])[0]):
        high = 0.0
    for _ in range(ROUNDS if high else 0):
        cuts = [low + (high - low) * i / WAYS for i in range(1, WAYS)]
        good = [fits(a, *s) for a, s in zip(cuts, sums_at(cuts))]
        first = good.index(True) if True in good else len(cuts)
        low, high = ([low, *cuts][first], [*cuts, high][first])
    exponent = round(high, 6)
    return exponent, sums_at([exponent])[0][0], whole.tokens


def source_plan(counted: DataFrame, entropy: float = 0.95, max_repeats: float = 4.0, budget: float = 1.0) -> DataFrame:
    """(source, docs, tokens, exponent, weight, passes, rest): one row for each source that has tokens.

    ``counted`` has source and tokens by document.
    """
    sums = materialize(counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).where("tokens > 0"), "sources")
    exponent, norm, tokens = exponent_of(sums, entropy, max_repeats, budget)
    weight = F.pow(F.col("tokens") / F.lit(float(tokens)), F.lit(exponent)) / F.lit(norm)
    planned = sums.withColumn("exponent", F.lit(exponent)).withColumn("weight", weight)
    planned = planned.withColumn("drawn", F.floor(F.col("weight") * budget * F.lit(tokens) + 0.5).cast("long"))
    return planned.select("source", "docs", "tokens", "exponent", "weight", F.expr("drawn div tokens").alias("passes"), F.expr("drawn % tokens").alias("rest"))


def _cuts(counted: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """(source, cut): the greatest hash of the last pass that still fits the rest of the source's tokens."""
    hashed = counted.join(plan.select("source", "docs", "passes", "rest"), counted["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    hashed = hashed.select("source", "tokens", "rest", "docs", permutation_hash(seed, F.col("source"), F.col("passes"), F.col("doc_id")).alias("hash"))
    place = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    slices = F.greatest(F.lit(1), F.ceil(F.col("docs") / SLICE))
    hashed = hashed.withColumn("slice", F.expr("cast(0 as bigint)") + (place * slices / F.lit(2**32)).cast("long"))
    sums = hashed.groupBy("source", "slice").agg(F.sum("tokens").alias("here"), F.first("rest").alias("rest"), F.max("hash").alias("last_hash"))
    run = sums.withColumn("upto", F.expr("sum(here) over (partition by source order by slice)"))
    whole = run.where("upto <= rest").groupBy("source").agg(F.max("last_hash").alias("whole"))
    split = run.where("upto > rest and upto - here <= rest").select("source", "slice", (F.col("upto") - F.col("here")).alias("before"))
    inside = hashed.alias("h").join(split.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")) & (F.col("h.slice") == F.col("s.slice"))).select("h.source", "h.hash", "h.tokens", "h.rest", "s.before")
    upto = F.expr("before + sum(tokens) over (partition by source order by hash range between unbounded preceding and current row)")
    partly = inside.withColumn("upto", upto).where("upto <= rest").groupBy("source").agg(F.max("hash").alias("partly"))
    both = whole.withColumnRenamed("whole", "cut").unionByName(partly.withColumnRenamed("partly", "cut"))
    return both.groupBy("source").agg(F.max("cut").alias("cut"))


def mix(docs: DataFrame, entropy: float = 0.95, max_repeats: float = 4.0, budget: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs`` drawn to the target weights: columns of ``docs`` plus ``block`` (the pass, from 0) and ``n_tokens``.

    Texts are never shuffled: a thin table of counts is written first, the
    plan (one row a source) is derived from it, and each document reads off
    in how many passes it stands.
    """
    counted = materialize(docs.select("doc_id", "source", count_tokens(F.col("text")).alias("tokens")), "counted")
    plan = materialize(source_plan(counted, entropy, max_repeats, budget), "plan")
    cuts = _cuts(counted, plan, seed)
    full = plan.join(cuts.withColumnRenamed("source", "cut_source"), plan["source"].eqNullSafe(F.col("cut_source")), "left")
    full = materialize(full.select(F.col("source").alias("_source"), "passes", "cut"), "plan")
    kept = [c for c in docs.columns if c not in ("block", "n_tokens")]
    drawn = docs.select(F.struct(*kept).alias("_doc"), count_tokens(F.col("text")).alias("n_tokens")).join(full, F.col("_doc.source").eqNullSafe(F.col("_source")))
    last = permutation_hash(seed, F.col("_source"), F.col("passes"), F.col("_doc.doc_id"))
    copies = F.col("passes") + F.when(last <= F.col("cut"), 1).otherwise(0)
    return drawn.withColumn("_copies", copies).where("_copies > 0").select("_doc.*", "n_tokens", F.explode(F.expr("sequence(0, _copies - 1)")).alias("block"))
