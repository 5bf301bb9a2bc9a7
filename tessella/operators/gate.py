"""The evidence gate, evidence tiers and review priorities, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Intents that ask for knowledge rather than a judgement (fixed values).
KNOWLEDGE = ("formula_knowledge", "herb_knowledge", "theory_knowledge")


def covered(groups: Column, terms: Column) -> Column:
    """Groups of which some member is among the terms."""
    return F.filter(groups, lambda g: F.arrays_overlap(g, terms))


def coverage(part: Column, whole: Column) -> Column:
    """size / size, 0 where the whole is empty."""
    return F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(0.0)


def decide(m: dict[str, Column], min_coverage: float = 1.0, min_confidence: float = 0.6) -> tuple[Column, Column]:
    """(status, reasons) from columns of the best match.

    ``m``: intent, needs_more, n_terms, has_match, exact, canonical, query_cov,
    groups_total, groups_missing, negative, forbidden, confidence, indistinct.
    """
    knows = m["intent"].isin(*KNOWLEDGE)
    none = F.lit(None).cast("string")
    say = lambda cond, code: F.when(cond, F.lit(code)).otherwise(none)
    least = F.when(m["groups_total"] > 0, 2).otherwise(3)
    clinical = F.array_compact(F.array(
        say(m["needs_more"], "translator_needs_more_info"), say(m["n_terms"] == 0, "no_canonical_terms"), say(m["negative"] > 0, "negative_evidence_conflict"), say(m["forbidden"] > 0, "forbidden_evidence_conflict"),
        say((m["groups_total"] > 0) & (m["groups_missing"] > 0), "missing_required_symptom_groups"), say(m["confidence"] < min_confidence, "payload_evidence_confidence_below_threshold"),
        say(m["canonical"] < least, "too_few_payload_matches"), say(m["query_cov"] < min_coverage, "low_query_coverage"), say(m["indistinct"], "competing_indistinguishable_matches"),
    ))
    no_match = ~m["has_match"]
    direct = (m["exact"] > 0) | (m["canonical"] >= 2)
    reasons = (
        F.when(m["intent"] == "unknown", F.array(F.lit("unknown_intent"))).when(no_match, F.array(F.lit("no_grounded_match")))
        .when(knows & (m["groups_missing"] > 0), F.array(F.lit("missing_required_knowledge_groups"))).when(knows & direct, F.array(F.lit("direct_knowledge_evidence_match")))
        .when(knows, F.array(F.lit("insufficient_knowledge_match"))).otherwise(clinical)
    )
    status = (
        F.when(m["intent"] == "unknown", "no_match").when(no_match, F.when(~knows & (m["n_terms"] > 0), "clarify").otherwise("no_match"))
        .when(knows & (m["groups_missing"] > 0), "clarify").when(knows & direct, "grounded").when(knows, F.when(m["canonical"] > 0, "clarify").otherwise("no_match"))
        .otherwise(F.when(F.size(clinical) > 0, "clarify").otherwise("grounded"))
    )
    return status, reasons


def tier(severe: Column, verified: Column, kind_ok: Column, confidence: Column, group_support: Column, diag_support: Column) -> Column:
    """quarantine, verified, high or medium."""
    high = kind_ok & (confidence >= 0.65) & (group_support >= 1) & (diag_support >= 0.5)
    return F.when(severe, "quarantine").when(verified, "verified").when(high, "high").otherwise("medium")


def priority(n_queries: Column, n_entries: Column, length: Column, sparse: int = 3, broad: int = 8) -> Column:
    """high, medium, broad_review_only or low, from how often and how widely a term is used."""
    return F.when(n_entries > broad, "broad_review_only").when(n_queries < sparse, "low").when(length >= 5, "high").otherwise("medium")
