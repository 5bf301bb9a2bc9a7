"""Questions in everyday words to the terms of a catalogue: what is said to be there, what is denied, and in which words.

Composed of joins and array functions around three runs of the automaton
(``operators/matcher.py``): over the texts, over what negations govern, and over
negations together with what they govern. A negation whose own words are a term
that names an absence ("no sweat" as a sign of its own) denies nothing. All that
belongs to one text is grouped by it and bounded by its length; catalogues may be
large, rule tables (``Rules``) are small and travel with the code.

Defined cases: null texts are empty and say nothing; texts whose key repeats are
told apart by it no further (keys should be unique); null and empty aliases are
left out; a term both said and denied is denied, unless one of ``overrides``
says that it is there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.negation import expand_synonyms
from tessella.functions.text import replace_in_order
from tessella.operators import matcher
from tessella.session import materialize


@dataclass(frozen=True)
class Rules:
    """How a language denies, and what follows from what; small tables."""

    negation: str  # a pattern whose group 1 is what the negation governs
    rhetorical: str = ""  # likewise, for questions that deny
    asked: tuple[str, ...] = ()  # ... but not where the match begins with these
    not_after: tuple[str, ...] = ()  # words right before a negation that undo it
    not_from: tuple[tuple[str, str], ...] = ()  # (before, beginning): a match with this beginning right after these words
    intensive: tuple[str, ...] = ()  # matches that begin with these deny nothing
    intensive_inside: tuple[str, ...] = ()  # nor those that hold these in their first characters
    connectors: str = ""  # what is governed ends before the first of these
    absences: tuple[str, ...] = ()  # terms that name an absence
    absence_starts: tuple[str, ...] = ()
    absence_ends: tuple[str, ...] = ()
    candidate_starts: tuple[str, ...] = ()  # of candidate terms only these beginnings count
    replacements: tuple[tuple[str, str], ...] = ()
    denied_by: dict[str, list[str]] = field(default_factory=dict)  # term: wordings that deny it
    overrides: dict[str, str] = field(default_factory=dict)  # term: pattern by which it is there all the same
    by_pattern: tuple[tuple[str, list[str]], ...] = ()  # (pattern, terms it stands for)
    equivalents: dict[str, list[str]] = field(default_factory=dict)
    denied_equivalents: dict[str, list[str]] = field(default_factory=dict)
    exclusive: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (term, terms that it rules out)


#: How denial is worded in Chinese questions.
CHINESE = Rules(
    negation=r"(?:完全|并|也|一直|从来|压根|绝对)?(?:不|没(?:有)?|无|未|勿)\s*([^，。；;、！？!?]{1,12})",
    rhetorical=r"(?:(?:怎么|咋)(?:会|能|可能)|(?:哪|哪里|谁说)(?:就|还|会|能|可能|有)?)([^，。；;、！？!?呢啊呀]{1,10})(?:呢|啊|呀)?",
    asked=("哪些", "哪几", "哪个", "哪味"),
    not_after=("能", "可", "有", "莫", "岂"),
    not_from=(("是", "不是"), ("止", "不住")),
    intensive=("不停", "不住", "不由自主", "不间断", "没完没了"),
    intensive_inside=("不停", "没完没了", "停不下来"),
    connectors=r"但是|只是|就是|而且|还|并且|也|就|是|吗",
    absence_starts=("无", "不", "未", "不得"),
    absence_ends=("不下", "不通"),
    candidate_starts=("无", "不得"),
)


def names_absence(term: Column, rules: Rules, candidate: bool = False) -> Column:
    """Whether a term's own words name an absence."""
    starts = rules.candidate_starts if candidate else rules.absence_starts
    tests = [term.isin(*rules.absences)] if rules.absences else []
    tests += [term.startswith(s) for s in starts] + [term.endswith(e) for e in rules.absence_ends]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def denials(text: str, rules: Rules) -> list[tuple[str, str, str, bool]]:
    """(whole match, some characters before it too, what is governed, rhetorical) for every negation that counts."""
    out = []
    for m in re.finditer(rules.negation, text):
        before, whole = text[: m.start()], m[0].strip()
        if before.endswith(rules.not_after or ("\0",)) or any(before.endswith(b) and text.startswith(s, m.start()) for b, s in rules.not_from):
            continue
        if whole.startswith(rules.intensive or ("\0",)) or any(w in whole[:8] for w in rules.intensive_inside):
            continue
        out.append((whole, text[max(0, m.start() - 4) : m.end()], _until(m[1], rules.connectors), False))
    for m in re.finditer(rules.rhetorical, text) if rules.rhetorical else ():
        if not m[0].startswith(rules.asked or ("\0",)):
            out.append((m[0].strip(), m[0], " ".join(m[1].split()), True))
    return [d for d in out if d[2]]


def _until(governed: str, connectors: str) -> str:
    governed = " ".join(governed.split())
    return " ".join((re.split(connectors, governed, maxsplit=1)[0] if connectors else governed).split())


def _scanner(rules: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Rules(**rules)
        for batch in batches:
            found = [(i, n, *d) for i, t in enumerate(batch.column(1).to_pylist()) for n, d in enumerate(denials(t or "", own))]
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
            columns = [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), *(pa.array([f[i + 1] for f in found], k) for i, k in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "whole", "context", "governed", "rhetorical"])

    return run


def _distinct_in_order(value: str, *order: str) -> Column:
    """The distinct values of a group in order of first appearance."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, value)))
    return F.array_distinct(F.transform(pairs, lambda p: p[value]))


def translate(texts: DataFrame, key: str, text: Column, aliases: DataFrame, rules: Rules = CHINESE, candidates: DataFrame | None = None) -> DataFrame:
    """(key, normalized, canonical_terms, primary_terms, colloquial_terms, negative_terms, negative_phrases, needs_more_info, expanded_query) for every text.

    ``aliases``: alias, canonical, place (as in ``matcher.expand_aliases``);
    ``candidates``: further terms (column ``term``), taken where a text has
    them literally.
    """
    normal = F.trim(F.regexp_replace(replace_in_order(F.coalesce(text, F.lit("")), list(rules.replacements)), r"\s+", " "))
    said = materialize(texts.select(F.col(key).alias("key"), normal.alias("text")), "normalized")
    terms = None if candidates is None else materialize(candidates.select(F.trim("term").alias("term")).where("length(term) between 2 and 16").distinct(), "candidates")
    also = aliases.where("alias <> canonical").groupBy("alias").agg(F.collect_set("canonical").alias("stands_for"))

    def names(rows: DataFrame, of: str) -> DataFrame:
        """(key, start, term, colloquial): terms of rows by alias, and candidates that the rows hold, with what these stand for."""
        hits = matcher.expand_aliases(rows, "key", F.col(of), aliases)
        found = hits.select("key", F.lit(0).alias("late"), "start", F.col("canonical").alias("term"), F.when(F.col("alias") != F.col("canonical"), F.col("alias")).alias("colloquial"))
        if terms is None:
            return found
        direct = matcher.find_terms(rows, "key", F.col(of), terms, "all").groupBy("key", "term").agg(F.min("start").alias("start"))
        return found.unionByName(direct.select("key", F.lit(1).alias("late"), (-F.length("term")).alias("start"), "term", F.lit(None).cast("string").alias("colloquial")))

    plain = {f: getattr(rules, f) for f in Rules.__dataclass_fields__}
    kind = dict(said.dtypes)["key"]
    scanned = said.mapInArrow(_scanner(plain), f"key {kind}, n int, whole string, context string, governed string, rhetorical boolean")
    scanned = materialize(scanned.select(F.struct("key", "n").alias("key"), "whole", "context", "governed", "rhetorical"), "denials")
    # Negations that are part of a term which names an absence.
    own = matcher.expand_aliases(scanned.where("not rhetorical"), "key", F.col("whole"), aliases)
    lexical = own.where(names_absence(F.col("canonical"), rules)).select("key")
    if terms is not None:
        absences = terms.where(names_absence(F.col("term"), rules, True))
        lexical = lexical.unionByName(matcher.find_terms(scanned.where("not rhetorical"), "key", F.col("context"), absences, "all").select("key"))
    counted = scanned.join(lexical.distinct(), "key", "left_anti")
    governed = names(counted, "governed").join(counted.select("key", "governed"), "key")
    denied = governed.select("key.key", F.col("key.n").alias("n"), "late", "start", "term", "governed")
    if rules.denied_by:
        wordings = [(term, wording) for term, own in rules.denied_by.items() for wording in own]
        listed = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(w).alias("governed"), F.lit(2**30 + i).alias("n")) for i, (t, w) in enumerate(wordings)])
        worded = said.select("key", "text", F.explode(listed).alias("d")).where("contains(text, d.governed)")
        denied = denied.unionByName(worded.select("key", "d.n", F.lit(0).alias("late"), F.lit(0).alias("start"), "d.term", "d.governed"))
    denied = denied.groupBy("key").agg(_distinct_in_order("term", "n", "late", "start").alias("denied"), _distinct_in_order("governed", "n").alias("negative_phrases"))
    there = names(said, "text").groupBy("key").agg(_distinct_in_order("term", "late", "start").alias("found"), F.array_compact(_distinct_in_order("colloquial", "late", "start")).alias("colloquial_terms"))
    return _settled(said.join(there, "key", "left").join(denied, "key", "left"), also, rules)


def _settled(rows: DataFrame, also: DataFrame, rules: Rules) -> DataFrame:
    """Expansions, exclusions and the wording, from each text's found and denied terms."""
    none = F.array().cast("array<string>")
    for c in ("found", "denied", "colloquial_terms", "negative_phrases"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    for pattern, terms in rules.by_pattern:
        rows = rows.withColumn("found", F.when(F.col("text").rlike(pattern), F.array_union("found", F.array(*map(F.lit, terms)))).otherwise(F.col("found")))
    for term, pattern in rules.overrides.items():
        rows = rows.withColumn("denied", F.when(F.col("text").rlike(pattern), F.array_remove("denied", term)).otherwise(F.col("denied")))
    rows = _with_names(rows, "denied", also)
    synonyms = lambda c, table: expand_synonyms(F.col(c), table, F.array(*[F.lit(x) for x in sorted({x for v in table.values() for x in v})])) if table else F.col(c)
    rows = rows.withColumn("denied", synonyms("denied", rules.equivalents)).withColumn("denied", synonyms("denied", rules.denied_equivalents))
    positive = F.array_except("found", "denied")
    rows = rows.withColumn("primary", F.array_except(positive, "colloquial_terms")).withColumn("primary", F.when(F.size("primary") > 0, F.col("primary")).otherwise(positive))
    rows = _with_names(rows, "primary", also).withColumn("positive", synonyms("primary", rules.equivalents)).withColumn("positive", F.array_except("positive", "denied"))
    for term, out in rules.exclusive:
        gone = F.array(*map(F.lit, out))
        for c in ("positive", "primary", "denied"):
            rows = rows.withColumn(f"_{c}", F.when(F.array_contains("positive", term), F.array_except(c, gone)).otherwise(F.col(c)))
        rows = rows.select(*[c for c in rows.columns if c not in ("positive", "primary", "denied") and not c.startswith("_")], *[F.col(f"_{c}").alias(c) for c in ("positive", "primary", "denied")])
    wording = F.concat_ws("\n", "text", F.array_join("positive", " "), F.array_join("colloquial_terms", " "), F.array_join("denied", " "))
    return rows.select(
        "key", F.col("text").alias("normalized"), F.col("positive").alias("canonical_terms"), F.col("primary").alias("primary_terms"), "colloquial_terms",
        F.col("denied").alias("negative_terms"), "negative_phrases", (F.size("positive") == 0).alias("needs_more_info"), wording.alias("expanded_query"),
    )


def _with_names(rows: DataFrame, column: str, also: DataFrame) -> DataFrame:
    """Terms that are themselves aliases bring the names they stand for, after them; a join, as catalogues may be large."""
    more = rows.select("key", F.explode(column).alias("alias")).join(also, "alias").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("stands_for")))).alias("_more"))
    return rows.join(more, "key", "left").withColumn(column, F.array_union(column, F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")
