"""The rarest words of documents, however many frequent ones each task turns away by itself."""

from tessella.plans import retrieval
from tessella.plans.catalog import SQL
from tests.support import assert_matches

SF = "/root/testdata/sf0.001"


def test_frequent_words_beyond_those_turned_away_first_do_not_count(spark, monkeypatch):
    for often in (0, 3):
        monkeypatch.setattr(retrieval, "OFTEN", often)
        assert_matches(retrieval.term_catalog(spark, SF), SF, SQL["term_catalog"])


def test_frequent_words_go_before_rows_are_dealt_out_by_word(spark):
    plan = retrieval.entry_terms(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan
