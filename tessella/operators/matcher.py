"""Dictionary matching in texts of any script by an automaton, and the choices among overlapping hits.

An Aho-Corasick automaton finds every occurrence of every term in one pass over
a text, whatever the number of terms. It is built from the catalogue once it is
counted: up to ``SHARD_CHARS`` characters it is broadcast and hits are chosen in
the same pass, over Arrow batches, so that no text is shuffled. A larger
catalogue is cut into ranges of terms (which share their first characters) of
that size, one automaton and one pass over the texts each; their hits then meet
by text. So neither the driver nor a worker holds more than one range.

Positions count from 1. Null texts are empty; empty and null terms, and those of
blanks only, match nothing; terms are trimmed; repeated terms are one; keys may
be null or repeat (rows of their own where the catalogue fits one automaton,
one text's hits together where it does not and keys are unique).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize

SHARD_CHARS = 2_000_000
#: Texts of one Arrow batch that are matched before hits are handed on.
PIECE = 500
CHOICES = ("all", "longest", "longest_later", "leftmost_once")


@dataclass(frozen=True)
class Context:
    """What must stand around a hit: it counts if one of ``after`` follows it, or one of ``before`` precedes it and none of ``refused`` does."""

    after: tuple[str, ...] = ()
    before: tuple[str, ...] = ()
    refused: tuple[str, ...] = ()

    def holds(self, text: str, start: int, end: int) -> bool:
        return text.startswith(self.after, end) or text.endswith(self.before, 0, start) and not text.endswith(self.refused, 0, start)


def choose(hits: list[tuple[int, str]], how: str) -> list[tuple[int, str]]:
    """The hits (start, term) that stay, by start.

    ``longest``: longest first, ties to the earlier start. ``longest_later``:
    ties to the later start. ``leftmost_once``: by start, the longest of one
    start first, and each term once; occurrences of one term do not overlap.
    """
    if how == "all":
        return sorted(hits)
    if how == "leftmost_once":
        return _leftmost(hits)
    sign = -1 if how == "longest_later" else 1
    taken: set[int] = set()
    chosen = []
    # What was taken before is at least as long, so if it overlaps a hit it covers one of its ends.
    for start, term in sorted(hits, key=lambda h: (-len(h[1]), sign * h[0], h[1])):
        if start not in taken and start + len(term) - 1 not in taken:
            taken.update(range(start, start + len(term)))
            chosen.append((start, term))
    return sorted(chosen)


def _leftmost(hits: list[tuple[int, str]]) -> list[tuple[int, str]]:
    free: dict[str, int] = {}
    apart = []
    for start, term in sorted(hits):
        if start >= free.get(term, 0):
            free[term] = start + len(term)
            apart.append((start, term))
    chosen, seen, end = [], set(), 0
    for start, term in sorted(apart, key=lambda h: (h[0], -len(h[1]))):
        if term not in seen and start >= end:
            chosen.append((start, term))
            seen.add(term)
            end = start + len(term)
    return chosen


def automaton(terms: list[str]):
    """An automaton of the terms; its hits are (place of the last character, length)."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for term in terms:
        made.add_word(term)
    made.make_automaton()
    return made


def _finder(shared, how: str, context: Context | None):
    """Of (key, text): (key, start, term)."""
    # As plain values: an instance would be looked for on workers by its module's name.
    rules = (context.after, context.before, context.refused) if context else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        around = Context(*rules) if rules else None
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                batch = whole.slice(at, PIECE)
                rows, starts, terms = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    if not text or not len(made):
                        continue
                    hits = [(end - n + 2, text[end - n + 1 : end + 1]) for end, n in made.iter(text)]
                    if around:
                        hits = [(s, t) for s, t in hits if around.holds(text, s - 1, s - 1 + len(t))]
                    for start, term in choose(hits, how):
                        rows.append(i)
                        starts.append(start)
                        terms.append(term)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(terms, pa.string())], names=["key", "start", "term"])

    return run


def _chooser(how: str):
    """Of (key, start, term) sorted by key: the hits that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            for key, start, term in zip(*(c.to_pylist() for c in batch.columns)):
                if held and key != now:
                    out += [(now, *h) for h in choose(held, how)]
                    held = []
                now = key
                held.append((start, term))
            yield emit(out, batch.schema)
        if held:
            yield emit([(now, *h) for h in choose(held, how)], batch.schema)

    def emit(rows: list, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(3)], names=["key", "start", "term"])

    return run


def find_terms(
    texts: DataFrame, key: str, text: Column, terms: DataFrame, how: str = "longest", context: Context | None = None, shard_chars: int = SHARD_CHARS
) -> DataFrame:
    """(key, start, term): the occurrences of ``terms`` (column ``term``) in every text that ``how`` keeps; with ``context`` only those it allows take part."""
    if how not in CHOICES:
        raise ValueError(f"how must be one of {CHOICES}")
    spark = texts.sparkSession
    known = materialize(terms.select(F.trim("term").alias("term")).where("term <> ''").distinct(), "terms")
    chars = known.agg(F.sum(F.length("term"))).first()[0] or 0
    said = texts.select(F.col(key).alias("key"), text.alias("text"))
    schema = f"key {dict(texts.dtypes)[key]}, start int, term string"
    shards = max(1, -(-chars // shard_chars))
    if shards == 1:
        shared = spark.sparkContext.broadcast(automaton([r.term for r in known.collect()]))
        return said.mapInArrow(_finder(shared, how, context), schema)
    dealt = materialize(known.repartitionByRange(shards, "term").withColumn("shard", F.spark_partition_id()), "shards")
    found = None
    for shard in range(shards):
        shared = spark.sparkContext.broadcast(automaton([r.term for r in dealt.where(F.col("shard") == shard).select("term").collect()]))
        hits = materialize(said.mapInArrow(_finder(shared, "all", context), schema), "hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found if how == "all" else found.repartition("key").sortWithinPartitions("key", "start").mapInArrow(_chooser(how), schema)


def expand_aliases(texts: DataFrame, key: str, text: Column, aliases: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(key, start, alias, canonical): the aliases of every text without overlaps, longest first and ties to the later start, with what they stand for.

    ``aliases``: alias, canonical, place. A name stands for itself; an alias of
    several names stands for the one with the least place, then the least name.
    """
    names = aliases.select(F.trim("canonical").alias("canonical"), F.trim("alias").alias("alias"), "place").where("canonical <> ''")
    own = names.select("canonical", F.col("canonical").alias("alias"), "place")
    every = names.where("alias <> ''").unionByName(own).groupBy("alias").agg(F.min(F.struct("place", "canonical")).alias("least"))
    every = materialize(every.select("alias", F.col("least.canonical").alias("canonical")), "aliases")
    hits = find_terms(texts, key, text, every.select(F.col("alias").alias("term")), "longest_later", shard_chars=shard_chars)
    return hits.withColumnRenamed("term", "alias").join(every, "alias").select("key", "start", "alias", "canonical")
