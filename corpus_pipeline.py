"""A corpus pipeline: toxic documents go, one of each group of near-duplicates
stays, sources are mixed to their target weights, and texts become token ids.

``STAGES`` are functions (spark, docs, sf_dir) -> DataFrame over what the stage
before has kept; ``run`` writes each result as Parquet and reads it again.

Defined cases, beside those of the operators: rows without an id are never
near-duplicates of others and stay; rows that repeat an id are one document, the
row with the least SHA-256 over its other columns;
mixing may repeat a document, and each copy is encoded; an empty table stays
empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, catalog, mixing, simhash, toxicity
from tessella.session import broadcast_small, materialize
from tessella.sources.tables import load

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL: the classifier is trained.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below 0.5."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model, keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near fingerprints the document with the smallest id.

    Texts are not shuffled unless the rows that go are too many to broadcast:
    what goes is found on ids and digests.
    """
    read = docs.select(*COLUMNS, _digest().alias("sha")).where("doc_id is not null")
    thin = materialize(read.groupBy("doc_id", "sha").agg(F.count("*").alias("copies")), "rows")
    least = simhash.near_duplicates(docs.where("doc_id is not null")).where("doc_id = component_id").select("doc_id").distinct()
    stay = thin.groupBy("doc_id").agg(F.min("sha").alias("sha")).join(least, "doc_id", "left_semi").withColumn("stays", F.lit(True))
    special = materialize(thin.join(stay, ["doc_id", "sha"], "left").where("stays is null or copies > 1").select("doc_id", "sha", "stays"), "special")
    single = read.join(broadcast_small(special.select("doc_id", "sha")), ["doc_id", "sha"], "left_anti")
    # Rows that agree in every column: whichever stays is the same.
    several = read.join(broadcast_small(special.where("stays").select("doc_id", "sha")), ["doc_id", "sha"], "left_semi").dropDuplicates(["doc_id"])
    return single.select(*COLUMNS).unionByName(several.select(*COLUMNS)).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def _digest() -> Column:
    """SHA-256 over all columns of a document but its id."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in COLUMNS[1:]]), 256)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by temperature mixing, copies included."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    coded = bpe.encode(docs, catalog._public("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
