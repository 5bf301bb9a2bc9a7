"""Blocks of records in texts of lines, read by a grammar that is data.

A block opens at a line that may be a name, if the next line that counts (lines
of punctuation only are looked past) confirms it; it holds what follows up to
the next opening. Its fields begin at lines with their own openings, in order,
and their fragments are joined, punctuation that stands on a line of its own
included. Scopes (a chapter, a grade) are carried from the last line that sets
them.

A text's lines are one state machine's run, over Arrow batches; texts are
independent and not shuffled. Defined cases: null and empty texts have no
blocks; lines before the first opening belong to none; blank lines do not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LineGrammar:
    """Patterns must match whole lines for ``name`` and ``scopes``, beginnings for the others."""

    name: str
    confirm: str
    passed_over: tuple[str, ...] = ()
    look: int = 7  # lines looked at after a name
    not_names: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()  # (field, pattern of the line it begins at), in order
    scopes: tuple[tuple[str, str], ...] = ()  # (scope, pattern whose group 1 sets it)
    ends_after: str = ""  # once this field has begun ...
    ends_at: str = ""  # ... the block ends at a line that begins like this
    opening: str = ""  # punctuation that joins what follows it
    closing: str = ""  # and what precedes it
    joint: str = ""  # between other fragments


SCHEMA = "block int, line int, name string, n_lines int, scopes map<string,string>, fields map<string,string>, body string"


def next_that_counts(lines: list[str], at: int, g: LineGrammar) -> str:
    """The next line after ``at`` within reach that is not looked past, without its blanks."""
    return next((line for line in lines[at + 1 : at + 1 + g.look] if line not in g.passed_over), "")


def joined(parts: list[str], g: LineGrammar) -> str:
    text = ""
    for part in parts:
        tight = not text or part in g.passed_over or part[0] in g.closing or text[-1] in g.opening
        text = text.rstrip() + part if part in g.passed_over or part[0] in g.closing else text + ("" if tight else g.joint) + part
    return text.strip()


def blocks(text: str, g: LineGrammar) -> list[dict]:
    numbered = [(n, " ".join(line.split())) for n, line in enumerate(text.split("\n"), 1) if line.strip()]
    lines = [line for _, line in numbered]
    scopes: dict[str, str] = {}
    starts: list[tuple[int, dict]] = []
    for i, line in enumerate(lines):
        for scope, pattern in g.scopes:
            if m := re.fullmatch(pattern, line):
                scopes = scopes | {scope: m[1]}
        if re.fullmatch(g.name, line) and line not in g.not_names and re.match(g.confirm, next_that_counts(lines, i, g)):
            starts.append((i, scopes))
    ends = [i for i, _ in starts[1:]] + [len(lines)]
    return [_block(lines[i:end], numbered[i][0], own, g) for (i, own), end in zip(starts, ends)]


def _block(lines: list[str], line: int, scopes: dict, g: LineGrammar) -> dict:
    body, at, now, seen = [], {}, None, False
    order = [f for f, _ in g.fields]
    for part in lines[1:]:
        if seen and g.ends_at and re.match(g.ends_at, part):
            break
        begins = next((f for f, p in g.fields if re.match(p, part) and f not in at and (now is None or order.index(f) > order.index(now))), None)
        if begins:
            now = begins
            at[now] = []
            seen = seen or now == g.ends_after
        if now:
            at[now].append(part)
        body.append(part)
    return {"line": line, "name": lines[0], "n_lines": len(body), "scopes": scopes, "fields": {f: joined(own, g) for f, own in at.items()}, "body": joined(body, g)}


def line_blocks(texts: DataFrame, key: str, text: str, grammar: LineGrammar) -> DataFrame:
    """(key, block, line, name, n_lines, scopes, fields, body) for every block, numbered from 0 within its text."""
    plain = asdict(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = LineGrammar(**plain)
        pairs = pa.map_(pa.string(), pa.string())
        kinds = {"block": pa.int32(), "line": pa.int32(), "name": pa.string(), "n_lines": pa.int32(), "scopes": pairs, "fields": pairs, "body": pa.string()}
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                found = [(i, n, b) for i, t in enumerate(batch.column(1).to_pylist()) for n, b in enumerate(blocks(t or "", g))]
                value = lambda n, b, f: n if f == "block" else list(b[f].items()) if f in ("scopes", "fields") else b[f]
                columns = [batch.column(0).take(pa.array([i for i, _, _ in found], pa.int64())), *(pa.array([value(n, b, f) for _, n, b in found], k) for f, k in kinds.items())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", *kinds])

    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {dict(texts.dtypes)[key]}, {SCHEMA}")
