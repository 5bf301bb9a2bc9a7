"""Splitting of texts by a hierarchy of separators, and of documents into parents and children by it.

A text is cut at the first separator it holds; pieces that are still too long
are cut at the separators after it, down to single characters. Neighbouring
pieces are then packed into chunks of at most ``size`` characters, each of which
repeats up to ``overlap`` characters of whole pieces of the one before. A piece
is longer than ``size`` only if no separator is left for it.

Documents are independent of each other: they are split over Arrow batches,
without a shuffle, and a document's work is bounded by its text. Defined cases:
null texts have no chunks; chunks are stripped of blanks at their ends, and empty
ones are left out.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import split_headers
from tessella.operators.chunking import _join_small

#: From paragraphs to characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of a text; a separator stays at the head of the piece after it."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Consecutive pieces as chunks of at most ``size``, where pieces allow it."""
    out: list[str] = []
    held: deque[str] = deque()
    total = 0

    def close() -> None:
        if chunk := "".join(held).strip():
            out.append(chunk)

    for piece in pieces:
        if held and total + len(piece) > size:
            close()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.popleft())
        held.append(piece)
        total += len(piece)
    close()
    return out


def split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The chunks of a text. Work is kept on a stack, so that its depth does not depend on the text."""
    out: list[str] = []
    # (text, separators left) to split, or (None, pieces) to pack.
    todo: list[tuple] = [(text, separators)]
    while todo:
        text, left = todo.pop()
        if text is None:
            out += pack(left, size, overlap)
            continue
        at = next((i for i, s in enumerate(left) if s in text), len(left) - 1)
        below, small, later = left[at + 1 :], [], []
        for piece in _cut(text, left[at]):
            if len(piece) < size:
                small.append(piece)
                continue
            if small:
                later.append((None, small))
                small = []
            later.append((piece, below) if below else (None, [piece]))
        if small:
            later.append((None, small))
        todo += reversed(later)
    return out


def merge_remains(pieces: list[str], least: int) -> list[str]:
    """Pieces below ``least`` characters go to the one before them, or else to the one after."""
    out: list[str] = []
    carried = ""
    for i, piece in enumerate(pieces):
        piece, carried = (carried + "\n\n" + piece if carried else piece), ""
        if len(piece) >= least or (not out and i == len(pieces) - 1):
            out.append(piece)
        elif out:
            out[-1] += "\n\n" + piece
        else:
            carried = piece
    return out


def recursive_chunks(texts: DataFrame, key: str, text: str, size: int = 400, overlap: int = 80, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(key, chunk, child): the chunks of every text, numbered from 0."""
    return _each(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), lambda t: split(t, size, overlap, separators) if t else [], "chunk", "child")


def recursive_parents(docs: DataFrame, key: str, text: str, least: int = 1500, most: int = 3500, overlap: int = 80, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(key, parent_id, parent): sections by header, small ones merged, large ones split recursively, small remains merged again."""
    sections = docs.select(F.col(key).alias("key"), _join_small(split_headers(F.coalesce(F.col(text), F.lit(""))), least).alias("sections"))

    def parents(own: list[str]) -> list[str]:
        parts = [p for s in own for p in ([s] if len(s) <= most else split(s, most, overlap, separators))]
        return merge_remains([p for p in parts if p], least)

    rows = _each(sections, parents, "i", "parent")
    return rows.select("key", F.concat(F.col("key").cast("string"), F.lit("_parent_"), F.col("i").cast("string")).alias("parent_id"), "parent")


def _each(rows: DataFrame, make, number: str, name: str) -> DataFrame:
    """(key, number, name): what ``make`` gives for the second column of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [make(t) for t in batch.column(1).to_pylist()]
                rows = [i for i, own in enumerate(found) for _ in own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([n for own in found for n in range(len(own))], pa.int32()), pa.array([c for own in found for c in own], pa.string())],
                    names=["key", number, name],
                )

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, {number} int, {name} string")
