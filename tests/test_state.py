"""Stateful streams against the same rows as a table, table functions, and re-ranking by a scorer."""

import time

import pytest
from pyspark.sql import functions as F

from tessella.functions import tables
from tessella.operators import rerank
from tessella.streaming import state

SF = "/root/testdata/sf0.001"
DDL = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def streamed(spark, folder, rows, run, name):
    """The rows of a stream that gets the events in three batches, in order of time."""
    ordered = rows.orderBy("ts", "event_id").limit(300).collect()
    for at in range(0, 300, 100):  # files are taken by the time they were written
        spark.createDataFrame(ordered[at : at + 100], DDL).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)
    stream = run(spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return sorted(map(tuple, spark.table(name).collect())), sorted(map(tuple, run(spark.read.parquet(f"{folder}/in")).collect()))


@pytest.mark.parametrize("name", ["budget", "breaker"])
def test_streams_agree_with_tables(spark, tmp_path, name):
    rows = spark.read.parquet(f"{SF}/events.parquet").select(*[c.split()[0] for c in DDL.split(", ")])
    run = {"budget": lambda df: state.budget(df, "user_id", 2), "breaker": lambda df: state.breaker(df, "user_id", F.col("value") < 60, 1)}[name]
    got, want = streamed(spark, tmp_path, rows, run, f"seen_{name}")
    assert got == want and len({r[-1] for r in got}) == 2


def test_a_changed_table_is_seen(spark, tmp_path):
    source, seen, version = str(tmp_path / "in"), [], {"v": "old"}
    read = lambda: spark.createDataFrame([(1, version["v"])], "k long, name string")
    write = lambda df, n: seen.extend(r.name for r in df.collect())
    for v in ("old", "new"):
        version["v"] = v
        spark.createDataFrame([(1,)], "k long").write.mode("append").parquet(source)
        state.with_fresh_table(spark.readStream.schema("k long").parquet(source), read, ["k"], write, str(tmp_path / "cp")).awaitTermination(120)
    assert seen == ["old", "new"]


def test_merged_state(spark):
    rows = [(1, 1, "a", False, ["x"], 1), (1, 2, "b", True, ["y", "x"], 2), (1, 3, "c", False, None, 3), (2, 1, "d", False, [], 4), (3, 1, "e", True, ["z"], 5)]
    out = state.merged_state(spark.createDataFrame(rows, "k int, o int, a string, r boolean, m array<string>, n int"), "k", "o", "a", "r", "m", "n")
    assert sorted(map(tuple, out.collect())) == [(1, ["c"], ["x", "y"], 6), (2, ["d"], [], 4), (3, [], ["z"], 5)]


def test_table_functions(spark):
    tables.register(spark)
    sql = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert sql("select * from ngrams('abcd', 3)") == [(0, "abc"), (1, "bcd")] and sql("select * from ngrams('ab', 3)") == [] == sql("select * from ngrams(null, 3)")
    assert sql("select * from chunks('abcdefgh', 4, 1)") == [(0, 0, "abcd"), (1, 3, "defg"), (2, 6, "gh")] and sql("select * from chunks('', 4, 1)") == []
    assert sql("select * from match_terms('xabcab', array('ab', 'abc', ''))") == [(1, "abc"), (4, "ab")]
    assert sql("select v, gram from values ('ab'), ('xyz') as t(v), lateral ngrams(v, 2) order by 1, 2") == [("ab", "ab"), ("xyz", "xy"), ("xyz", "yz")]


def test_scorer(spark):
    rows = spark.createDataFrame([(1, "ab", "abc"), (2, None, "x"), (3, "q", None)], "id long, q string, e string")
    out = rerank.scored(rows, "q", "e", lambda pairs: [len(q) + len(e) / 10 for q, e in pairs], batch=2)
    assert sorted((r.id, r.rerank_score) for r in out.collect()) == [(1, 2.3), (2, 0.1), (3, 1.0)]
    with pytest.raises(Exception, match="scores for"):
        rerank.scored(rows, "q", "e", lambda pairs: []).collect()


def test_swap_in(spark):
    none, groups = F.array().cast("array<string>"), F.array(F.array(F.lit("a")), F.array(F.lit("b")))
    made = [(1, 1, "s1", 1.0, 3, True), (1, 2, "s2", 0.5, 2, True), (1, 3, "s3", 0.9, 3, True), (1, 4, "s4", 0.95, 3, False), (1, 5, "s3", 1.0, 3, False), (1, 6, "s5", 0.96, 3, False)]
    rows = spark.createDataFrame(made, "query long, key long, source string, query_coverage double, primary_count int, full boolean").withColumn("place", F.col("key"))
    rows = rows.withColumn("intent", F.lit("clinical_symptom")).withColumn("kind", F.lit("formula_syndrome")).withColumn("groups", groups).withColumn("matched_groups", F.when(F.col("full"), groups).otherwise(F.array(F.array(F.lit("a")))))
    rows = rows.withColumn("negative_conflicts", none).withColumn("forbidden_conflicts", none)
    out = {r.slot: r.key for r in rerank.swap_in(rows, "query", "source", "place", 3).collect()}
    # 4 takes the place of 2, the weakest; 5 has the identity of 3; 6 takes the place of 3, as the first always stays.
    assert out == {1: 1, 2: 4, 3: 6}
