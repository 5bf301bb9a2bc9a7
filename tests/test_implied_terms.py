"""Edges of words beside letters that are not ASCII, against the SQL."""

from tessella.plans.catalog import QUERIES, SQL
from tests.support import assert_matches


def test_edges_beside_accents(spark, tmp_path):
    texts = ["édie à", "die", "dieé", "thé x", "ñthe", "_the", "the9", "中the中", "éthe die", "ßdieß", None, "xdie thex"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "conversations.parquet")
    rows = QUERIES["implied_terms"](spark, str(tmp_path))
    assert "article,german" in {r.implied for r in rows.collect()}
    assert_matches(rows, str(tmp_path), SQL["implied_terms"])
