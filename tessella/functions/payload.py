"""Flattening of nested records into text, and what may count as a term. Null fields hold nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from tessella.functions.text import clean_text, let


def _none() -> Column:
    return F.array().cast("array<string>")


def flat(value: Column, kind: DataType) -> Column:
    """All texts inside a value of any schema, in order; null and empty ones are left out."""
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType):
            out = value
        else:
            out = F.flatten(F.transform(value, lambda x: flat(x, kind.elementType)))
    elif isinstance(kind, StructType):
        out = F.concat(_none(), *[flat(value[f.name], f.dataType) for f in kind.fields])
    elif isinstance(kind, MapType):
        out = flat(F.map_values(value), ArrayType(kind.valueType))
    else:
        out = F.array(value.cast("string"))
    return F.filter(F.coalesce(out, _none()), lambda x: x.isNotNull() & (x != ""))


def values(rows: DataFrame, fields: list[str]) -> Column:
    """The texts of the fields, in the order of ``fields``."""
    return F.concat(_none(), *[flat(F.col(f), rows.schema[f].dataType) for f in fields])


def lexical_text(rows: DataFrame, fields: list[str]) -> Column:
    """The text that lexical search sees: all values, joined and cleaned."""
    return clean_text(F.array_join(values(rows, fields), " "))


def contains_term(text: Column, term: Column) -> Column:
    """Whether a text holds a term; an empty term stands in none."""
    return F.coalesce((term != "") & F.contains(text, term), F.lit(False))


def labelled_text(rows: DataFrame, fields: list[str], most: int = 1800) -> Column:
    """``field: values`` lines of the fields that hold something, cut at ``most`` characters."""
    line = lambda f: let(flat(F.col(f), rows.schema[f].dataType), lambda v: F.when(F.size(v) > 0, F.concat(F.lit(f"{f}: "), F.array_join(v, " "))))
    return F.left(F.concat_ws("\n", *[line(f) for f in fields]), F.lit(most))


def catalog_text(term: Column, roles: Column, evidence: Column, most: int = 220) -> Column:
    """term。roles。evidence, the latter cut and left out where it is the term."""
    said = F.left(F.coalesce(F.trim(evidence), F.lit("")), F.lit(most))
    role = F.array_join(F.filter(F.coalesce(roles, _none()), lambda r: F.trim(r) != ""), " ")
    return F.concat_ws("。", F.trim(term), F.when(role != "", role), F.when((said != "") & (said != F.trim(term)), said))


def record_hash(rows: DataFrame, fields: list[str]) -> Column:
    """SHA-256 of the compact JSON of the fields with sorted keys; null fields stand as null."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def rankable(term: Column, most: int, singles: tuple[str, ...] = ()) -> Column:
    """Longer than one character and no longer than ``most``, or one of the listed single characters."""
    return ((F.length(term) > 1) & (F.length(term) <= most)) | term.isin(*singles) if singles else (F.length(term) > 1) & (F.length(term) <= most)


def rankable_terms(first: Column, otherwise: Column | None, most: int) -> Column:
    """The distinct rankable terms of ``first``, or of ``otherwise`` where that is empty."""
    own = F.coalesce(first, _none())
    chosen = own if otherwise is None else F.when(F.size(own) > 0, own).otherwise(F.coalesce(otherwise, _none()))
    return F.array_distinct(F.filter(chosen, lambda t: rankable(t, most)))


def usable_term(term: Column, stop: tuple[str, ...] = (), least: int = 2, most: int = 24) -> Column:
    """2 to 24 characters, no stop term, not a number."""
    good = F.length(term).between(least, most) & ~term.rlike(r"^[0-9.]+$")
    return good & ~term.isin(*stop) if stop else good


def unsupported(values_: Column, listed: Column, evidence: Column) -> Column:
    """Values that hold no listed term which the evidence lacks."""
    return F.filter(values_, lambda v: ~F.exists(listed, lambda t: F.contains(v, t) & ~F.contains(evidence, t)))


def clause_count(text: Column, marks: str = r"[，,。；;！!？?\n]") -> Column:
    """Clauses that are not blank."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), marks), lambda c: F.trim(c) != ""))


def clean_query(text: Column, suffix: str) -> Column:
    """A question without its closing instruction (pattern ``suffix``), single blanks, no closing marks."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), suffix, "")), r"\s+", " ")
    return F.regexp_replace(bare, r"^[ 。；;]+|[ 。；;]+$", "")


def expanded_query(parts: dict[str, Column]) -> Column:
    """``label values`` lines of the parts that hold something."""
    return F.concat_ws("\n", *[F.when(F.size(F.coalesce(v, _none())) > 0, F.concat(F.lit(f"{label} "), F.array_join(v, " "))) for label, v in parts.items()])


def merged_terms(existing: Column, primary: Column, negated: Column, predictions: Column, least: float, most: int, primaries: int) -> Column:
    """struct(terms, primary, accepted): predictions (array of struct term, score) that score well and are not negated join the terms."""
    good = F.slice(F.filter(predictions, lambda p: (p["term"] != "") & (p["score"] >= least) & ~F.array_contains(F.coalesce(negated, _none()), p["term"])), 1, most)
    names = F.transform(good, lambda p: p["term"])
    room = F.greatest(F.lit(0), F.lit(primaries) - F.size(primary))
    return F.struct(F.array_distinct(F.concat(existing, names)).alias("terms"), F.array_distinct(F.concat(primary, F.slice(names, F.lit(1), room))).alias("primary"), F.size(good).alias("accepted"))


def mutated(text: Column, pairs: list[tuple[str, str]], seed: str) -> Column:
    """One confusion of speech recognition: of the pairs whose first part the text holds, the one that a seeded hash picks is swapped in."""
    options = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(a)), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in pairs]))
    pick = F.get(options, F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(seed + "|"), text), 256), 1, 8), 16, 10).cast("long"), F.size(options)).cast("int"))
    return F.when(F.size(options) > 0, F.replace(text, pick["a"], pick["b"])).otherwise(text)


def answer_route(status: Column, intent: Column, strict: bool = True) -> Column:
    """structured, clarify, refuse or open: what a decision leads to."""
    refuse = F.lit(strict) & (status == "no_match") & intent.isin("clinical_symptom", "unknown")
    return F.when(status == "grounded", "structured").when((intent == "clinical_symptom") & (status == "clarify"), "clarify").when(refuse, "refuse").otherwise("open")
