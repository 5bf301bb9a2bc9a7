"""Required groups of terms, read from a text's statement of what it is recognised by.

A statement such as "recognised by A and B, C or D, E" is found in the text,
cut at its separators, and each part divided: into alternatives, at observations
of another kind, and into the terms the record already knows (longest first),
with what is left over between them. Every piece is a place in the source text
from the first step to the last, so the offsets of a group are those of its
words. A piece with its synonyms is a group; groups that share a term, one
inside another counting as shared, are merged in order of appearance.

The grammar is data (``Grammar``). Records are independent, so they are read
over Arrow batches without a shuffle; a record's work is bounded by its text.

Defined cases: a null text has no statement; null lists are empty; of several
statements the last counts; a record without a statement has no groups from it
and says so in ``reasons``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

Span = tuple[int, int]

SCHEMA = (
    "key {key}, phrase string, phrase_start int, phrase_end int, groups array<array<string>>, "
    "traces array<struct<axis:string,term:string,start:int,end:int,excerpt:string,in_evidence:boolean>>, clarify array<string>, reasons array<string>"
)


@dataclass(frozen=True)
class Grammar:
    """How statements are worded; patterns are regular expressions."""

    statement: str  # has a group named phrase
    separator: str
    alternative: str
    opening: str  # grammar words before a piece
    closing: str  # and after it
    edges: str  # characters trimmed from pieces
    axes: tuple[tuple[str, str, tuple[str, ...]], ...]  # (axis, start | in, markers): the first that fits
    other_axis: str
    main_axes: tuple[str, ...]
    clarify: tuple[tuple[tuple[str, ...], str], ...] = ()
    observed: tuple[tuple[str, str], ...] = ()  # (marker, character that must not precede it): a new observation starts here
    observed_first: tuple[str, ...] = ()  # markers that count at the start of a part only
    divided: str = ""  # an observation is cut where this marker appears later
    unfinished: tuple[str, ...] = ()  # what is left over is dropped when it ends in these
    generic: tuple[str, ...] = ()
    noise: str = r"[A-Za-z]"
    refused: tuple[str, ...] = ()  # markers that rule a term of the evidence out
    longest: int = 20
    most_groups: int = 8


#: How classical formula texts state what a pattern is recognised by.
CLASSICAL = Grammar(
    statement=r"(?:临床应用)?以(?P<phrase>[^。\n]{2,220}?)为(?:辨证(?:治)?|证治)要点",
    separator=r"[，、；;]+",
    alternative=r"(?:或|或见|以及|及)",
    opening=r"(?:甚则|并见|兼见|伴有|可见|出现|表现为|泻必|泻后|时有|而|且|与)+",
    closing=r"(?:者|为宜|等)",
    edges=" ，、；;。",
    axes=(
        ("tongue", "start", ("舌", "苔")), ("pulse", "in", ("脉",)), ("cold_heat", "in", ("寒", "冷", "热", "温", "凉")),
        ("fluid_surface", "in", ("汗", "渴", "饮")), ("elimination", "in", ("便", "泻", "痢", "尿", "溺", "淋")),
    ),
    other_axis="main_symptom",
    main_axes=("main_symptom", "elimination"),
    clarify=((("舌", "苔"), "舌象"), (("脉",), "脉象"), (("汗",), "是否出汗"), (("渴", "饮"), "是否口渴"), (("便", "泻", "痢"), "大便情况"), (("尿", "溺", "淋"), "小便情况")),
    observed=(("舌", "口"), ("脉", "")),
    observed_first=("苔",),
    divided="脉",
    unfinished=("必", "而", "且", "伴"),
    refused=("证", "所治", "因", "属于"),
)


def statement(text: str, g: Grammar) -> Span | None:
    """Where the last statement's phrase stands, without blanks and stops around it."""
    found = None
    for found in re.finditer(g.statement, text, re.MULTILINE):
        pass
    if found is None:
        return None
    lo, hi = _strip(text, *found.span("phrase"), " ：:，,。")
    return (lo, hi) if lo < hi else None


def _strip(text: str, lo: int, hi: int, edges: str) -> Span:
    while lo < hi and text[lo] in edges:
        lo += 1
    while lo < hi and text[hi - 1] in edges:
        hi -= 1
    return lo, hi


def trimmed(text: str, span: Span, g: Grammar) -> Span:
    """A piece without the stops and grammar words at its ends."""
    lo, hi = _strip(text, *span, g.edges)
    if m := re.compile(g.opening).match(text, lo, hi):
        lo = m.end()
    for m in re.compile(g.closing).finditer(text, lo, hi):
        if m.end() == hi:
            hi = m.start()
            break
    return _strip(text, lo, hi, g.edges)


def _cut(pattern: str, text: str, span: Span) -> list[Span]:
    """The spans between the matches of a pattern."""
    out, at = [], span[0]
    for m in re.compile(pattern).finditer(text, *span):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, span[1])]


def pieces(text: str, span: Span, known: list[str], g: Grammar) -> list[Span]:
    """A part divided into observations, known terms and what is left between them; each wording once."""
    lo, hi = trimmed(text, span, g)
    if hi - lo < 2:
        return []
    at = [p for marker, before in g.observed if (p := text.find(marker, lo, hi)) >= 0 and not (before and p > lo and text[p - 1] == before)]
    at += [lo for marker in g.observed_first if text.startswith(marker, lo, hi)]
    if at:
        first = min(at)
        found = pieces(text, (lo, first), known, g) if first > lo else []
        cut = text.find(g.divided, first + 1, hi) if g.divided else -1
        parts = [trimmed(text, p, g) for p in ((first, cut), (cut, hi))] if cut > 0 else [(first, hi)]
        return _distinct(text, [*found, *(p for p in parts if p[0] < p[1])])
    taken: list[Span] = []
    for term in known:
        p = text.find(term, lo, hi)
        if p >= 0 and all(p + len(term) <= a or b <= p for a, b in taken):
            taken.append((p, p + len(term)))
    taken.sort()
    found, cursor = list(taken), lo
    for a, b in [*taken, (hi, hi)]:
        rest = trimmed(text, (cursor, a), g)
        if rest[1] - rest[0] >= 2 and not text[slice(*rest)].endswith(g.unfinished or ("\0",)):
            found.append(rest)
        cursor = b
    return _distinct(text, found or [(lo, hi)])


def _distinct(text: str, spans: list[Span]) -> list[Span]:
    by: dict[str, Span] = {}
    for s in spans:
        by.setdefault(text[slice(*s)].strip(), s)
    return [s for word, s in by.items() if word]


def parts(text: str, phrase: Span, known: list[str], g: Grammar) -> list[list[Span]]:
    """The statement's groups of places: alternatives together, everything else alone."""
    out: list[list[Span]] = []
    for part in _cut(g.separator, text, phrase):
        part = trimmed(text, part, g)
        choices = [c for c in _cut(g.alternative, text, part) if (t := trimmed(text, c, g))[0] < t[1]]
        found = _distinct(text, [s for c in choices for s in pieces(text, c, known, g)]) if len(choices) > 1 else pieces(text, part, known, g)
        out += [found] if len(choices) > 1 and found else [] if len(choices) > 1 else [[s] for s in found]
    return out


def _unique(terms) -> list[str]:
    return list(dict.fromkeys(t.strip() for t in terms if t and t.strip()))


def with_synonyms(terms: list[str], rules: list[list[str]], aliases: dict[str, list[str]], g: Grammar) -> list[str]:
    """Terms, the rule groups that name them or are named by them, and their aliases."""
    out = list(terms)
    for term in terms:
        for rule in rules:
            if any(term in r or r in term for r in rule):
                out += rule
        out += aliases.get(term, [])
    return [t for t in _unique(out) if 1 < len(t) <= g.longest]


def overlap(a: list[str], b: list[str]) -> bool:
    return any(x in y or y in x for x in a for y in b if len(x) > 1 and len(y) > 1)


def axis_of(term: str, g: Grammar) -> str:
    for axis, how, markers in g.axes:
        if any(term.startswith(m) if how == "start" else m in term for m in markers):
            return axis
    return g.other_axis


def read_record(record: dict, rules: list[list[str]], aliases: dict[str, list[str]], g: Grammar) -> dict:
    """Groups, where their terms stand, what is to be asked, and why the record is not to be used as it is."""
    text, evidence = record["raw_text"] or "", record["evidence"] or ""
    listed = {f: _unique(record[f] or []) for f in ("known", "differential", "forbidden")}
    known = sorted({t for t in (*listed["known"], *listed["differential"]) if 1 < len(t) <= 20 and t not in g.generic}, key=lambda t: (-len(t), t))
    place = statement(text, g)
    phrase = text[slice(*place)] if place else ""
    groups: list[list[str]] = []
    homes: list[list[Span]] = []
    if place:
        groups = [_unique(own) for own in record["existing"] or [] if any(t and t in phrase for t in own)]
        homes = [[] for _ in groups]
        for spans in parts(text, place, known, g):
            group = with_synonyms([text[slice(*s)] for s in spans], rules, aliases, g)
            if not group:
                continue
            at = next((i for i, old in enumerate(groups) if overlap(group, old)), None)
            if at is None:
                groups.append(group)
                homes.append(list(spans))
            else:
                groups[at] = _unique([*groups[at], *group])
                homes[at] += spans
    _supplement(groups, homes, listed["differential"], evidence, rules, aliases, g)
    traces = [_trace(text, evidence, place, group, spans, g) for group, spans in zip(groups, homes)] if place else []
    seen = {t["axis"] for t in traces if t["term"]}
    checks = {
        "missing_explicit_diagnostic_phrase": not phrase, "fewer_than_two_required_groups": len(groups) < 2, "too_many_required_groups": len(groups) > g.most_groups,
        "untraced_required_group": any(t["start"] < 0 for t in traces), "required_forbidden_conflict": bool({t for own in groups for t in own} & set(listed["forbidden"])),
        "ascii_source_noise": bool(re.search(g.noise, phrase)), "missing_main_symptom_axis": not seen & set(g.main_axes),
    }
    asked = _unique(field for own in groups for markers, field in g.clarify if any(m in t for m in markers for t in own))
    start, end = place or (-1, -1)
    return {"phrase": phrase, "phrase_start": start, "phrase_end": end, "groups": groups, "traces": traces, "clarify": asked, "reasons": [r for r, bad in checks.items() if bad]}


def _supplement(groups: list, homes: list, differential: list[str], evidence: str, rules, aliases, g: Grammar) -> None:
    """Adds terms of the evidence until there are two groups and one of a main axis."""
    enough = lambda: len(groups) >= 2 and any(axis_of(own[0], g) in g.main_axes for own in groups if own)
    for term in differential:
        if enough():
            return
        span = trimmed(term, (0, len(term)), g)
        term = term[slice(*span)]
        if 2 < len(term) <= 16 and term in evidence and axis_of(term, g) in g.main_axes and not any(m in term for m in g.refused):
            group = with_synonyms([term], rules, aliases, g)
            if group and not any(overlap(group, old) for old in groups):
                groups.append(group)
                homes.append([])


def _trace(text: str, evidence: str, place: Span, group: list[str], spans: list[Span], g: Grammar) -> dict:
    """The place of the group's first term that the statement has; else that of one anywhere in the text."""
    homes = {text[slice(*s)]: s for s in reversed(spans)}
    term = next((t for t in group if t in homes or text.find(t, *place) >= 0), None) or next((t for t in group if t in text), "")
    start = -1
    if term:
        start = homes[term][0] if term in homes else text.find(term, *place)
        start = start if start >= 0 else text.find(term)
    end = start + len(term) if start >= 0 else -1
    around = text[max(0, start - 24) : end + 24] if start >= 0 else ""
    return {"axis": axis_of(term or group[0], g), "term": term, "start": start, "end": end, "excerpt": around, "in_evidence": bool(term) and term in evidence}


def required_groups(records: DataFrame, key: str, rules: list[list[str]] = (), aliases: dict[str, list[str]] | None = None, grammar: Grammar = CLASSICAL) -> DataFrame:
    """``SCHEMA`` for every record; ``records`` has raw_text, evidence, known, differential, forbidden (arrays) and existing (array of arrays).

    ``rules`` and ``aliases`` are the grammar's synonyms: small tables that travel with the code.
    """
    plain, rules, aliases = asdict(grammar), [list(r) for r in rules], dict(aliases or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(**plain)
        for batch in batches:
            found = [read_record(r, rules, aliases, g) for r in batch.select(fields[1:]).to_pylist()]
            columns = [batch.column(0), *(pa.array([r[f.name] for r in found], f.type) for f in list(kinds)[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=kinds.names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = ["key", "raw_text", "evidence", "known", "differential", "forbidden", "existing"]
    schema = SCHEMA.format(key=dict(records.dtypes)[key])
    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return records.selectExpr(f"`{key}` as key", *fields[1:]).mapInArrow(run, schema)
