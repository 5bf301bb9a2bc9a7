"""Word overlap counts every word of a query, however common."""

import re

from tessella.plans.catalog import QUERIES


def test_common_words_count(spark, tmp_path):
    docs = [(i, "s1", "wholly common words here") for i in range(60)] + [(60, "s1", "wholly common words here too")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(0, "Common words"), (1, "wholly, too"), (2, "nothing")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = lambda t: set(re.findall(r"\w+", t.lower()))
    want = []
    for q, t in asked:
        hits = sorted((-len(words(t) & words(d[2])), d[0]) for d in docs if words(t) & words(d[2]))
        want += [(q, key, -n, rank) for rank, (n, key) in enumerate(hits[:5], 1)]
    assert sorted(map(tuple, QUERIES["payload_overlap_all_words"](spark, str(tmp_path)).collect())) == sorted(want)
    assert QUERIES["payload_overlap_route"](spark, str(tmp_path)).where("query = 0").count() == 0
    assert QUERIES["rrf_fusion_all_words"](spark, str(tmp_path)).where("query = 0 and n_routes = 2").count() > 0
