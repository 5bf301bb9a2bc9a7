"""Ranking of candidates for a query: what an entry shares with it, what rules it out, and in which order the rest stand.

An entry has required groups of synonyms, diagnostic and differential terms,
and terms it forbids; a query has terms, the primary ones first, and terms it
negates. All functions take and return Columns; null arrays count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import gate
from tessella.operators.retrieval import top_k

#: Intents and the kinds of entry that answer them, by weight.
PRIORITY = {
    "herb_indication": {"herb_indication": 6},
    "classical_theory": {"classical_theory": 6},
    "acupuncture_principle": {"classical_acupuncture_principle": 6},
    "formula_knowledge": {"formula_syndrome": 6, "classical_clause": 5},
    "clinical_symptom": {"formula_syndrome": 5, "classical_acupuncture": 5, "classical_clause": 4},
}
#: The same where the intent is none of these, and what a formula counts where its kind has no weight.
OTHERWISE = {"formula_syndrome": 4, "classical_clause": 3}
FORMULA = {"formula_knowledge": 4, "": 2}
#: Intents that a direct match may answer without shared terms.
DIRECT = ("formula_knowledge", "herb_indication", "classical_theory", "acupuncture_principle")
#: Kinds of entry whose forbidden terms rule them out, and phrases that explain.
STRICT_KINDS = ("formula_syndrome", "classical_clause")
PHRASES = ("独取寸口", "寸口脉平", "针有补泻")
MARKERS = {"所谓": 3, "故曰|故谓": 2, "何谓": 1}
TOLD, TOLD_UNLESS = "经言", "所谓|故曰|何谓"


def _listed(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def source_priority(kind: Column, intent: Column, intervention: Column | None = None) -> Column:
    """0 to 6: how well a kind of entry answers an intent."""
    formula = F.lit(False) if intervention is None else F.coalesce(intervention == "formula", F.lit(False))

    def weight(table: dict[str, int], rest: Column) -> Column:
        out = rest
        for name, n in table.items():
            out = F.when(kind == name, n).otherwise(out)
        return out

    other = weight(OTHERWISE, F.when(formula, FORMULA[""]).otherwise(F.when(kind == "classical_theory", 1).otherwise(0)))
    for name, table in PRIORITY.items():
        rest = F.when(formula, FORMULA[name]).otherwise(0) if name in FORMULA else F.lit(0)
        other = F.when(intent == name, weight(table, rest)).otherwise(other)
    return other


def explanatory_priority(kind: Column, terms: Column, text: Column, direct: Column, question: Column, asked: Column) -> Column:
    """A bonus for entries that explain: terms in their direct fields, all terms in their question, and words of explanation."""
    text, direct, question, asked = (F.coalesce(c, F.lit("")) for c in (text, direct, question, asked))
    long = F.filter(_listed(terms), lambda t: F.length(t) > 1)
    bonus = F.size(F.filter(long, lambda t: F.contains(direct, t)))
    bonus = bonus + F.when((kind == "classical_theory") & (F.size(long) > 0) & F.forall(long, lambda t: F.contains(question, t)), 4).otherwise(0)
    for phrase in PHRASES:
        bonus = bonus + F.when(F.contains(asked, F.lit(phrase)) & F.contains(direct, F.lit(phrase)), 5).otherwise(0)
    for words, n in MARKERS.items():
        bonus = bonus + F.when(text.rlike(words), n).otherwise(0)
    bonus = bonus - F.when(F.contains(text, F.lit(TOLD)) & ~text.rlike(TOLD_UNLESS), 1).otherwise(0)
    return F.when(kind.isin("classical_acupuncture_principle", "classical_theory"), bonus).otherwise(0)


def evidence_terms(query: Column, entry: Column, forbidden: Column, required: Column, compatible: dict[str, list[str]] | None = None) -> Column:
    """Terms of a query that an entry holds as positive evidence: not those it forbids, nor those whose opposite it requires."""
    held = F.array_except(F.array_intersect(_listed(query), _listed(entry)), _listed(forbidden))
    for term, opposites in (compatible or {}).items():
        against = F.exists(F.flatten(required), lambda g: g.isin(*opposites))
        held = F.when(against, F.array_remove(held, term)).otherwise(held)
    return held


def matched(rows: DataFrame) -> DataFrame:
    """``rows`` with the features of a match.

    Takes query, primary, negated (arrays of the query), intent, kind, terms
    (all positive terms of the entry), groups (array of arrays), diagnostic,
    differential, forbidden.
    """
    q, primary = _listed(F.col("asked")), _listed(F.col("primary"))
    hit = lambda c: F.array_intersect(q, _listed(F.col(c)))
    share = lambda part, whole: F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(F.lit(0.0))
    out = rows.select(
        "*", hit("terms").alias("matched_terms"), F.array_intersect(primary, _listed(F.col("terms"))).alias("matched_primary"),
        F.array_intersect(_listed(F.col("negated")), _listed(F.col("terms"))).alias("negative_conflicts"), hit("forbidden").alias("forbidden_conflicts"),
        gate.covered(F.col("groups"), q).alias("matched_groups"), hit("diagnostic").alias("matched_diagnostic"), hit("differential").alias("matched_differential"),
    )
    return out.select(
        "*", F.size("matched_terms").alias("canonical_count"), F.size("matched_primary").alias("primary_count"), share(F.col("matched_primary"), primary).alias("query_coverage"),
        share(F.col("matched_groups"), F.col("groups")).alias("group_coverage"), share(F.col("matched_diagnostic"), F.col("diagnostic")).alias("diagnostic_coverage"),
        share(F.col("matched_differential"), F.col("differential")).alias("differential_coverage"),
        F.aggregate("matched_terms", F.lit(0), lambda n, t: n + F.length(t)).alias("specificity"), source_priority(F.col("kind"), F.col("intent")).alias("source_priority"),
    )


def overlap_points() -> Column:
    """The score of the overlap route: 10 a primary term, 2 a term, 5 times coverage, group coverage, priority."""
    return F.round(F.col("primary_count") * 10.0 + F.col("canonical_count") * 2.0 + F.col("query_coverage") * 5.0 + F.col("group_coverage") + F.col("source_priority"), 6)


def ruled_out() -> Column:
    """Why a candidate goes, or null: a negated term, a forbidden one, or nothing shared that could answer."""
    clinical = F.col("intent") == "clinical_symptom"
    direct = (F.col("exact") > 0) & F.col("intent").isin(*DIRECT)
    return (
        F.when(clinical & (F.size("negative_conflicts") > 0), "negative").when(clinical & F.col("kind").isin(*STRICT_KINDS) & (F.size("forbidden_conflicts") > 0), "forbidden")
        .when((F.col("canonical_count") <= 0) & ~direct, "no_overlap")
    )


def signature() -> Column:
    """2: three terms and three quarters of the query; 1: groups complete, half of the query, two terms; else 0."""
    quiet = (F.col("intent") == "clinical_symptom") & (F.size("negative_conflicts") == 0) & (F.size("forbidden_conflicts") == 0)
    complete = (F.size("groups") == 0) | (F.col("group_coverage") >= 1)
    strong = (F.col("primary_count") >= 3) & (F.col("query_coverage") >= 0.75)
    fair = complete & (F.col("query_coverage") >= 0.5) & (F.col("primary_count") >= 2)
    return F.when(quiet & strong, 2).when(quiet & fair, 1).otherwise(0)


def local_rank_keys() -> list[Column]:
    """The twenty components of the local order, each descending."""
    cov, groups = F.col("query_coverage"), F.col("group_coverage")
    yes = lambda c: c.cast("int")
    return [
        signature(), F.col("source_priority"), yes((groups >= 1) & (cov >= 0.5)), yes((cov >= 0.75) & (F.col("canonical_count") >= 3)), cov, yes(groups >= 1), groups, F.col("canonical_count"),
        F.size("matched_groups"), F.size("matched_diagnostic"), F.col("diagnostic_coverage"), F.size("matched_differential"), F.col("differential_coverage"), F.col("specificity"), F.col("exact"),
        F.col("explanatory"), F.col("overlap"), F.col("n_routes"), F.col("rrf_score"), F.col("score"),
    ]


def evidence_keys() -> list[Column]:
    """The six components that evidence-first re-ranking puts before the score."""
    return [signature(), F.col("canonical_count"), F.size("matched_diagnostic"), (F.col("query_coverage") >= 1).cast("int"), F.col("source_priority"), F.col("explanatory")]


def local_rank(rows: DataFrame, query: str, tie: str, k: int) -> DataFrame:
    """The best ``k`` of each query in the local order; ties to the smaller ``tie``."""
    return top_k(rows, [query], [*[c.desc() for c in local_rank_keys()], F.asc(tie)], k)


def indistinct(ranked: DataFrame, query: str, identity: str, rank: str = "rank", rivals: int = 3) -> DataFrame:
    """The first of each query with ``indistinct``: whether the next few, of another identity and about as good, share all its terms.

    At most ``rivals`` + 1 rows of a query are gathered.
    """
    few = ranked.where(F.col(rank) <= rivals + 1)
    row = F.struct(F.col(rank).alias("rank"), F.col(identity).alias("identity"), F.col("primary_count").alias("n"), F.col("group_coverage").alias("groups"), F.col("matched_terms").alias("terms"))
    lists = few.groupBy(F.col(query).alias("_q")).agg(F.sort_array(F.collect_list(row)).alias("_all"))
    top = F.col("_all")[0]
    rival = F.filter("_all", lambda x: (x["rank"] > 1) & ~x["identity"].eqNullSafe(top["identity"]) & (x["n"] >= F.greatest(F.lit(1), top["n"] - 1)) & (x["groups"] >= F.greatest(F.lit(0.0), top["groups"] - 0.25)))
    own = F.filter(F.array_except(top["terms"], F.flatten(F.transform(rival, lambda x: x["terms"]))), lambda t: F.length(t) >= 2)
    judged = lists.select("_q", ((F.size(rival) > 0) & (F.size(own) == 0)).alias("indistinct"))
    return few.where(F.col(rank) == 1).join(judged, F.col(query).eqNullSafe(F.col("_q"))).drop("_q")


def should_retain(least: float = 0.8) -> Column:
    """Whether a candidate that lacks a group deserves a place all the same."""
    return (
        (F.col("intent") == "clinical_symptom") & F.col("kind").isin(*STRICT_KINDS) & (F.size("matched_groups") < F.size("groups"))
        & (F.size("negative_conflicts") == 0) & (F.size("forbidden_conflicts") == 0) & (F.col("query_coverage") >= least) & (F.col("primary_count") >= 3)
    )


def rank_within(rows: DataFrame, query: str, order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(query).orderBy(*order)))
