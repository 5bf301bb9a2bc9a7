"""Every registered query against its SQL."""

import pytest

from tessella.plans.catalog import QUERIES, SQL
from tests.support import assert_matches

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert_matches(QUERIES[name](spark, SF), SF, SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_each_status_and_main_reasons_occur(spark):
    rows = QUERIES["evidence_gate"](spark, SF).collect()
    assert {r.status for r in rows} == {"grounded", "clarify", "no_match"}
    said = {x for r in rows for x in r.reasons.split(",")}
    assert {"unknown_intent", "missing_required_symptom_groups", "negative_evidence_conflict", "direct_knowledge_evidence_match"} <= said
