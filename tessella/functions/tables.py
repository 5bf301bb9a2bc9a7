"""Table functions for SQL: ``register(spark)`` makes ngrams, chunks and match_terms known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="place int, gram string")
class Ngrams:
    """Character n-grams with their place from 0; a null or short text has none."""

    def eval(self, text: str, n: int):
        for i in range(len(text or "") - n + 1 if n > 0 else 0):
            yield i, text[i : i + n]


@udtf(returnType="chunk int, start int, text string")
class Chunks:
    """Windows of ``size`` characters, each ``overlap`` into the one before; an empty text has none."""

    def eval(self, text: str, size: int, overlap: int):
        if size <= overlap:
            raise ValueError("overlap must be below size")
        step = size - overlap
        for i, at in enumerate(range(0, max(1, len(text or "") - overlap), step) if text else ()):
            yield i, at, text[at : at + size]


@udtf(returnType="start int, term string")
class MatchTerms:
    """Occurrences of the terms, longest first at each place, without overlaps."""

    def eval(self, text: str, terms: list[str]):
        text, at = text or "", 0
        known = sorted({t for t in terms or [] if t}, key=lambda t: (-len(t), t))
        while at < len(text):
            hit = next((t for t in known if text.startswith(t, at)), None)
            if hit:
                yield at, hit
            at += len(hit) if hit else 1


def register(spark: SparkSession) -> None:
    for name, f in (("ngrams", Ngrams), ("chunks", Chunks), ("match_terms", MatchTerms)):
        spark.udtf.register(name, f)
