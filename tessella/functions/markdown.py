"""Fields, sections and quality of Markdown and model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import let, strip


def sections(text: Column) -> Column:
    """array<struct<title, body>> of the second-level headings."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?m)^## "), lambda s: strip(s) != "")
    return F.transform(parts, lambda s: F.struct(strip(F.substring_index(s, "\n", 1)).alias("title"), strip(F.regexp_replace(s, r"^[^\n]*\n?", "")).alias("body")))


def labeled_fields(text: Column, labels: list[str]) -> Column:
    """map<label, text>: a line ``label:`` opens a field, following lines belong to it; the first of a label counts."""
    literal = "|".join("".join("\\" + c if not (c.isalnum() or c == " ") else c for c in x) for x in labels)
    cut = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?ms)^(?:{literal})[:：].*?(?=^(?:{literal})[:：]|\z)"), F.lit(0))
    pairs = F.transform(cut, lambda s: F.struct(F.regexp_extract(s, r"^([^:：]*)", 1).alias("key"), strip(F.regexp_replace(s, r"^[^:：]*[:：]", "")).alias("value")))
    first = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, p: F.when(F.exists(acc, lambda a: a["key"] == p["key"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(first)


def paired_lines(text: Column) -> Column:
    """array<struct<name, dose>>: lines taken two by two; a last name may lack its dose."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: strip(x)), lambda x: x != "")

    def pair(ls: Column) -> Column:
        starts = F.filter(F.transform(ls, lambda _, i: i), lambda i: i % 2 == 0)
        return F.transform(starts, lambda i: F.struct(F.get(ls, i).alias("name"), F.get(ls, i + 1).alias("dose")))

    return let(lines, pair)


def strip_dose(text: Column) -> Column:
    """Without metric amounts."""
    return strip(F.regexp_replace(text, r"[(（]?\d+(?:\.\d+)?\s*(?:kg|mg|ml|g|克|毫升)[)）]?", ""))


def quality(text: Column) -> Column:
    """struct<words, headers, tables, formulas, mean_line, empty_ratio> of a Markdown text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.split(t, "\n")
    full = F.filter(lines, lambda x: strip(x) != "")
    mean = F.when(F.size(full) > 0, F.length(F.array_join(full, "")) / F.size(full)).otherwise(0.0)
    return F.struct(
        F.regexp_count(t, F.lit(r"[^\s]+")).cast("long").alias("words"), F.regexp_count(t, F.lit(r"(?m)^#{1,6} ")).cast("long").alias("headers"), F.contains(t, F.lit("|")).alias("tables"), F.contains(t, F.lit("$")).alias("formulas"),
        F.round(mean, 4).alias("mean_line"), F.round((F.size(lines) - F.size(full)) / F.size(lines), 4).alias("empty_ratio"),
    )


def fenced_json(text: Column) -> Column:
    """The JSON of a model's answer: that of its first fenced block, else the answer itself; null if neither parses."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.coalesce(inner, F.lit("")) != "", inner).otherwise(text)
    return F.when(F.try_parse_json(body).isNotNull(), strip(body))


def direction(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The class whose keywords occur most (the first of equals), null if none does."""
    literal = lambda w: "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in w)
    score = lambda words: sum((F.regexp_count(F.coalesce(text, F.lit("")), F.lit(literal(w))) for w in words), F.lit(0))
    ranked = F.array(*[F.struct(score(ws).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("label")) for i, (k, ws) in enumerate(keywords.items())])
    return let(F.array_max(ranked), lambda best: F.when(best["n"] > 0, best["label"]))
