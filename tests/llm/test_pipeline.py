"""The pipeline's stages, each on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    kept = cp.drop_toxic(spark, docs, SF)
    assert tuple(kept.columns) == cp.COLUMNS
    left = {r.doc_id for r in kept.collect()}
    assert len(toxic & left) <= 0.1 * len(toxic) and len(left) >= 0.8 * docs.count()
    small = docs.where("doc_id < 400")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in small.collect()]
    want = {d for (d, _), c in zip(rows, brute_components(rows)) if d == c}
    once = cp.drop_near_duplicates(spark, small, SF)
    assert tuple(once.columns) == cp.COLUMNS and {r.doc_id for r in once.collect()} == want
    mixed = cp.mix_sources(spark, small, SF)
    assert tuple(mixed.columns) == cp.COLUMNS and mixed.count() > 0


def test_repeated_and_missing_ids(spark, docs):
    own = docs.select(*cp.COLUMNS)
    out = cp.drop_near_duplicates(spark, own, SF).collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in out) == 1


def test_the_row_that_stays_does_not_depend_on_layout(spark):
    rows = [(1, "first text here", "en", "a", 15), (1, "second text here", "en", "a", 16), (1, "first text here", "de", "b", 15), (1, "first text here", "en", "a", 15), (2, "other words that stay", None, None, None)]
    found = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        frame = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        found.add(tuple(sorted(map(tuple, cp.drop_near_duplicates(spark, frame, SF).collect()))))
    assert len(found) == 1 and [r[0] for r in found.pop()] == [1, 2]


def stages(spark, docs, tmp_path):
    """What each stage gives, with ``docs`` in the place of ``documents``."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 1), (None, 0, 1), (5, 1, None), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        now = cp.materialize(stage(spark, now, str(tmp_path)), name)
        out.append(now)
    return out


def test_edge_rows_pass_all_stages(spark, docs, tmp_path):
    """Null columns, empty and very long texts, repeated rows, and extra columns whose names clash."""
    clean, once, mixed, coded = stages(spark, docs.withColumn("score", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("sha", F.lit(2)), tmp_path)
    assert all(tuple(d.columns) == cp.COLUMNS for d in (clean, once, mixed))
    ids = [r.doc_id for r in once.collect()]
    assert len(set(ids)) == len(ids) and set(ids) <= {r.doc_id for r in clean.collect()}
    assert mixed.count() == coded.count() and {r.doc_id for r in mixed.collect()} <= set(ids)
    own = {r.doc_id: r.text for r in mixed.collect()}
    import hashlib

    assert all(r.decoded_sha256 == hashlib.sha256((own[r.doc_id] or "").encode()).hexdigest() for r in coded.collect())


def test_an_empty_table_stays_empty(spark, no_docs, tmp_path):
    assert [d.count() for d in stages(spark, no_docs, tmp_path)] == [0, 0, 0, 0]


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where(F.size("ids") != F.col("n_tokens")).count() == 0
