"""Canonical exact digests of documents.

Text is put into Unicode normal form KC, lower-cased, and every run of white
space becomes one space (none at the ends). Two 64-bit xxhash values of the
UTF-8 bytes, the second chained on another seed, make a wide digest. Rows of
equal digests fall into one bucket, where the bytes themselves are compared;
a row whose bytes differ from its bucket's least text is set apart by a digest
of its own.

Defined cases: a null text counts as empty; empty texts are equal to each
other; repeated rows are each kept; an empty table gives an empty table; very
long texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize

#: Chained before the text for the second half of the digest, so that both halves are independent.
SECOND = "second half"


def canonical(text: Column) -> Column:
    """Unicode normal form KC, lower case, single spaces."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.trim(F.regexp_replace(F.lower(composed), r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+", " "))


def wide_hash(canon: Column) -> Column:
    """A struct of two 64-bit hashes of a canonical text."""
    return F.struct(F.xxhash64(canon).alias("a"), F.xxhash64(F.lit(SECOND), canon).alias("b"))


def digest_string(wide: Column) -> Column:
    """32 lower-case hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(wide["a"]), 16, "0"), F.lpad(F.hex(wide["b"]), 16, "0")))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, wide): one row for each of ``docs``, read once, without a shuffle."""
    return docs.select(F.col(key).alias("key"), canonical(F.col(text)).alias("canon")).select("key", wide_hash(F.col("canon")).alias("wide"))


def mixed_buckets(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(wide, least_canon): of the buckets in ``shared``, those whose texts (``wide``, ``canon``) differ in a byte.

    A bucket's texts are all equal if its least is its greatest: tasks reduce
    their own rows first, so a hot bucket is one row a task.
    """
    ends = texts.join(shared.select("wide"), "wide").groupBy("wide").agg(F.min("canon").alias("least_canon"), F.max("canon").alias("most_canon"))
    return materialize(ends.where("least_canon <> most_canon").select("wide", "least_canon"), "mixed")


def set_apart(texts: DataFrame, mixed: DataFrame) -> DataFrame:
    """``texts`` (``wide``, ``canon``) with ``fingerprint``: in a mixed bucket, texts that are not its least add their own digest."""
    own = F.col("canon") != F.col("least_canon")
    plain = digest_string(F.col("wide"))
    joined = texts.join(mixed, "wide", "left")
    return joined.withColumn("fingerprint", F.when(own, F.concat(plain, F.lit("-"), F.sha2("canon", 256))).otherwise(plain)).drop("least_canon")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed: DataFrame | None = None) -> DataFrame:
    """(key, fingerprint, group): group is the smallest key of the documents with equal canonical bytes.

    Only buckets of two rows or more have their texts compared; the rest of
    the corpus moves 16 bytes a row, and nothing is collected by bucket.
    """
    hashed = materialize(digests(docs, key, text), "digests") if hashed is None else hashed
    shared = materialize(hashed.groupBy("wide").agg(F.count("*").alias("n"), F.min("key").alias("first")).where("n > 1").drop("n"), "buckets")
    rows = docs.select(F.col(key).alias("key"), canonical(F.col(text)).alias("canon")).withColumn("wide", wide_hash(F.col("canon")))
    mixed = mixed_buckets(rows, shared)
    if mixed.isEmpty():
        return hashed.join(shared, "wide", "left").select("key", digest_string(F.col("wide")).alias("fingerprint"), F.coalesce("first", "key").alias("group"))
    named = materialize(set_apart(rows, mixed).select("key", "fingerprint"), "named")
    return named.join(named.groupBy("fingerprint").agg(F.min("key").alias("group")), "fingerprint").select("key", "fingerprint", "group")


def following(rows: DataFrame, by: list[str], bring: list[str] | None = None) -> DataFrame:
    """``rows`` (distinct in ``by``) with ``next_<column>`` for ``by`` and ``bring``: the row after each in ascending order of ``by``, the first after the last.

    Rows are range-partitioned and numbered by partition; a window then runs
    inside each partition, and the ends meet through one row a partition.
    """
    carried = [*by, *(bring or [])]
    spread = materialize(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    own = F.struct(*carried)
    inside = spread.withColumn("_next", F.lead(own).over(Window.partitionBy("_part").orderBy(*by)))
    heads = spread.groupBy("_part").agg(F.min_by(own, F.struct(*by)).alias("head"))
    # One row a partition: small, whatever the number of documents.
    ring = heads.selectExpr("_part", f"coalesce(lead(head) over (order by _part), min_by(head, struct({', '.join('head.' + b for b in by)})) over ()) as head")
    out = inside.join(F.broadcast(ring), "_part").withColumn("_next", F.coalesce("_next", "head"))
    return out.select(*rows.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in carried])
