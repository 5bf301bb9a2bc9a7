"""Negation in free text as array functions: spans after a negation, split on connectors, less lexicalised absences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import let

#: Negations, connectors that end or divide a negated span, and what a span must not begin with (fixed values by language).
NEGATIONS = ("没有", "无", "不", "未", "否认", "并非", "no ", "not ", "without ", "nicht ", "kein ", "keine ", "sin ", "pas de ", "sans ")
CONNECTORS = ("和", "及", "、", "或", " and ", " or ", " und ", " oder ", " y ", " o ", " et ", " ou ")
BEFORE = "(?<![能可有莫岂])(?<!是不)"
INTENSIFIERS = ("太", "很", "过", "very ", "sehr ", "muy ", "très ")


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(sorted((w.replace(" ", r"\s") for w in words), key=len, reverse=True)) + ")"


def negated_spans(text: Column, reach: int = 24) -> Column:
    """The spans that negations govern: up to a stop, split on connectors, intensified ones left out."""
    pattern = f"(?iu){BEFORE}{_any(NEGATIONS)}(?!{_any(INTENSIFIERS)})([^,.;!?，。；！？\\n]{{1,{reach}}})"
    spans = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    parts = F.flatten(F.transform(spans, lambda s: F.split(s, f"(?iu){_any(CONNECTORS)}")))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def negated_terms(text: Column, terms: Column, lexical: tuple[str, ...] = ()) -> Column:
    """Terms that stand in a negated span, but not those that are themselves absences (``lexical``), nor those also said without negation."""

    def pick(spans: Column) -> Column:
        inside = lambda t: F.exists(spans, lambda s: F.contains(F.lower(s), F.lower(t)))
        own = (lambda t: ~t.isin(*lexical)) if lexical else (lambda t: F.lit(True))
        return F.filter(terms, lambda t: inside(t) & own(t))

    return let(negated_spans(text), pick)


def is_negated(text: Column, term: str, reach: int = 8) -> Column:
    """Whether some occurrence of ``term`` has a negation within ``reach`` characters before it, with no stop between."""
    literal = "".join("\\" + c if not (c.isalnum() or c.isspace()) else c for c in term)
    return F.coalesce(text, F.lit("")).rlike(f"(?iu){BEFORE}{_any(NEGATIONS)}[^,.;!?，。；！？\\n]{{0,{reach}}}{literal}")


def resolve_conflicts(present: Column, absent: Column, exclusive: list[tuple[str, str]]) -> Column:
    """Present terms without those that are denied, and of each exclusive pair only the first."""
    kept = F.array_except(present, absent)
    for keep, drop in exclusive:
        kept = F.when(F.array_contains(kept, keep), F.array_remove(kept, drop)).otherwise(kept)
    return kept


def expand_synonyms(terms: Column, synonyms: dict[str, list[str]], allowed: Column) -> Column:
    """One step of synonym closure within ``allowed`` (a map literal, so it is as small as the code that holds it)."""
    if not synonyms:
        return terms
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.array_union(terms, F.array_intersect(more, allowed))
