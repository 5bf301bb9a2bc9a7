"""Rewriting of texts until no rule applies any more.

Rules are literals or patterns, each applied to its own fixed point, in order.
Only rows that a rule matches leave the JVM; every application must shorten the
text, so that the number of rounds of a row is bounded by its length. Null texts
stay null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(text: str, rules: list[tuple[str, str]], literal: bool = True) -> str:
    """The text after every rule has been applied as long as it changes something."""
    for old, new in rules:
        while True:
            after = text.replace(old, new) if literal else re.sub(old, new, text)
            if after == text:
                break
            if len(after) >= len(text):
                raise ValueError(f"rule {old!r} does not shorten the text")
            text = after
    return text


def to_fixed_point(rows: DataFrame, text: str, rules: list[tuple[str, str]], literal: bool = True) -> DataFrame:
    """``rows`` with ``text`` rewritten. Patterns are those that Java and Python read alike; a replacement names groups as \\\\1."""
    if literal and any(not old or len(new) >= len(old) for old, new in rules):
        raise ValueError("a literal rule must shorten the text")
    if not rules:
        return rows
    applies = reduce(lambda a, b: a | b, [F.contains(F.col(text), F.lit(old)) if literal else F.col(text).rlike(old) for old, _ in rules])
    applies = F.coalesce(applies, F.lit(False))
    at, rules = rows.columns.index(text), [tuple(r) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = pa.array([settle(t, rules, literal) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([done if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return rows.where(~applies).unionByName(rows.where(applies).mapInArrow(run, rows.schema))


def without_annotations(rows: DataFrame, text: str, annotations: dict[str, str]) -> DataFrame:
    """``rows`` whose texts have lost the annotations that stand right after their terms, several times or mixed up.

    First each term's own annotation goes, longest terms first, until none is
    left; then runs of any term's annotations after a term.
    """
    terms = sorted(annotations, key=len, reverse=True)
    own = to_fixed_point(rows, text, [(t + annotations[t], t) for t in terms if annotations[t]])
    values = "|".join(_quoted(v) for v in sorted({v for v in annotations.values() if v}, key=len, reverse=True))
    out = F.col(text)
    for term in terms if values else ():
        out = F.regexp_replace(out, f"({_quoted(term)})(?:{values})+", "$1")
    return own.withColumn(text, out)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in text)
