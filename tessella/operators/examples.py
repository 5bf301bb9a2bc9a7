"""Training examples from questions and a catalogue: a positive and a hashed negative for every expected term.

Which entry of a term stands for it, and which term is the negative, follow from
SHA-256 of the question's id (``functions.hashing.stable_index``), so they do not
depend on layout. Terms and entries are numbered by range (``operators/neighbours.py``)
and found by equi-joins on these numbers: no catalogue is collected, and no
product is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.neighbours import running_totals
from tessella.session import materialize


def _index(key: Column, size: Column) -> Column:
    """A place in [0, size) from SHA-256, for a size that is a column."""
    return F.conv(F.left(F.sha2(key, 256), F.lit(15)), 16, 10).cast("bigint") % size


def numbered_catalogue(catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (term, entry, text): terms (term, place, n_entries) and entries (term, entry, text, at), both numbered from 0."""
    own = catalogue.where("term is not null and term <> ''").dropDuplicates(["term", "entry"]).withColumn("one", F.lit(1).cast("long"))
    entries = materialize(running_totals(own, ["term"], ["entry"], {"at": "one"}).select("term", "entry", "text", (F.col("at") - 1).alias("at")), "entries")
    terms = entries.groupBy("term").agg(F.count("*").alias("n_entries")).withColumn("one", F.lit(1).cast("long")).withColumn("all", F.lit(0))
    terms = running_totals(terms, ["all"], ["term"], {"place": "one"}).select("term", (F.col("place") - 1).alias("place"), "n_entries")
    return materialize(terms, "terms"), entries


def training_examples(questions: DataFrame, catalogue: DataFrame, seed: int = 0) -> DataFrame:
    """(id, term, label, other, entry, text): for every expected term of a question an entry of it (label 1) and one of another term (label 0).

    ``questions``: id, query, term (one row an expected term). A negative that
    the question expects moves on to the next term; if it expects that as
    well, the question has no negative for this term. Terms that the catalogue
    does not have, and questions without text, give nothing; repeated rows of
    a question count once.
    """
    terms, entries = numbered_catalogue(catalogue)
    n = terms.count()
    asked = questions.where("trim(query) <> '' and term is not null").select(F.col("id"), F.trim("query").alias("query"), F.trim("term").alias("term")).dropDuplicates(["id", "term"])
    asked = materialize(asked.where("term <> ''"), "asked")
    known = asked.join(terms.select("term", "n_entries"), "term")
    pick = lambda term, key: F.col("at") == _index(key, F.col("n_entries"))
    said = F.concat_ws(":", F.col("id").cast("string"), "term")
    positive = known.join(entries, "term").where(pick("term", said)).select("id", "term", F.lit(1).alias("label"), F.col("term").alias("other"), "entry", "text")
    if not n:
        return positive
    offset = _index(F.concat(F.lit(f"negative:{seed}:"), said), F.lit(n).cast("long"))
    steps = known.select("id", "query", "term", F.explode(F.array(*[F.struct(F.lit(s).alias("step"), ((offset + s) % n).alias("place")) for s in (0, 1)])).alias("t"))
    tried = steps.select("id", "query", "term", "t.step", "t.place").join(terms.select(F.col("term").alias("other"), "place", "n_entries"), "place")
    free = tried.join(asked.select("id", F.col("term").alias("other")), ["id", "other"], "left_anti")
    chosen = free.groupBy("id", "query", "term").agg(F.min(F.struct("step", "other", "n_entries")).alias("c")).select("id", "query", "term", "c.other", "c.n_entries")
    named = entries.withColumnRenamed("term", "other")
    negative = chosen.join(named, "other").where(pick("other", F.concat("query", "other"))).select("id", "term", F.lit(0).alias("label"), "other", "entry", "text")
    return positive.unionByName(negative)


def positive_groups(questions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(term, query, entry, text): each wording of a question once for every term it expects, under its first id, with the entry that stands for the term."""
    terms, entries = numbered_catalogue(catalogue)
    asked = questions.select("id", F.trim("query").alias("query"), F.trim("term").alias("term")).where("query <> '' and term <> ''")
    first = asked.groupBy("query", "term").agg(F.min("id").alias("id")).join(terms.select("term", "n_entries"), "term")
    place = _index(F.concat_ws(":", F.col("id").cast("string"), "term"), F.col("n_entries"))
    return first.withColumn("at", place).join(entries, ["term", "at"]).select("term", "query", "entry", "text")
