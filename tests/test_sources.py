"""Readers, writers and streams."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import profile
from tessella.sources import files
from tessella.streaming import events


def test_jsonl_strict_and_tolerant(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('﻿{"a": 1}\nnot json\n[1]\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(path), "a int", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(path), "a int").collect()


def test_csv_falls_back_through_encodings(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("名,值\n中文,1\n".encode("gbk"))
    assert [tuple(r) for r in files.read_csv(spark, str(path)).collect()] == [("中文", "1")]


def test_csv_of_many_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffname,text\nx,\"two\nlines, a comma\"\n".encode())
    (tmp_path / "b.csv").write_bytes("name,text\n\u540d,\n".encode("gb18030"))
    (tmp_path / "c.csv").write_bytes(b"name,text\ncaf\xe9\xff,y\n")
    got = {tuple(r) for r in files.read_csv(spark, str(tmp_path)).collect()}
    assert got == {("x", "two\nlines, a comma"), ("\u540d", None), ("caf\xe9\xff", "y")}
    assert files.read_csv(spark, str(tmp_path), rows=1).count() == 1
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
    assert files.sniff_columns(["Id", "Question_zh", "Answer"], {"q": ("question", "ask"), "a": ("answer",), "z": ("none",)}) == {"q": "Question_zh", "a": "Answer"}


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    (tmp_path / "b.txt").write_text("only")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_lines(spark, str(tmp_path)).collect()
        assert len(rows) == 5001 and all(r.value in ("only", f"line {r.line}") for r in rows)
        assert files.read_lines(spark, str(tmp_path), limit=3).count() == 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_table_is_replaced_by_one_that_reads_it(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.replace_table(spark.range(5), path) == 5
    assert files.replace_table(spark.read.parquet(path).where("id > 1"), path) == 3
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4] and {p.name for p in tmp_path.iterdir()} == {"t"}


def test_lines_markdown_and_manifest(spark, tmp_path):
    (tmp_path / "x.md").write_text("# T\nbody")
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe")
    assert [(r.line, r.value) for r in files.read_lines(spark, str(tmp_path / "x.md")).collect()] == [(1, "# T"), (2, "body")]
    assert [(r.source, r.text) for r in files.read_markdown(spark, str(tmp_path)).collect()] == [("x", "# T\nbody")]
    rows = {r.path.rsplit("/", 1)[-1]: r for r in profile.manifest(spark, str(tmp_path)).collect()}
    assert rows["x.md"].valid_utf8 and not rows["bad.bin"].valid_utf8 and rows["x.md"].bytes == 8


def test_writers_and_store(spark, tmp_path):
    frame = spark.range(10).withColumn("g", F.col("id") % 2)
    assert files.write_jsonl(frame, str(tmp_path / "j"), ("g",)) == 10
    assert files.write_capped(frame, str(tmp_path / "c"), 3, [F.asc("id")]) == {"total": 10, "written": 3, "truncated": True}
    assert files.replace_table(frame, str(tmp_path / "t")) == 10 == spark.read.parquet(str(tmp_path / "t")).count()
    store = files.ParentStore(spark, str(tmp_path / "p"))
    store.save(spark.createDataFrame([("d_parent_10", "ten"), ("d_parent_2", "two")], "parent_id string, content string"))
    asked = spark.createDataFrame([("d_parent_10",), ("d_parent_2",), ("d_parent_2",), ("none",)], "parent_id string")
    assert [r.content for r in store.load(asked).collect()] == ["two", "ten"]
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert files.render_dialogue(turns).first().markdown == "**User:** a\n\n**Assistant:** b"


def test_stream_windows_match_batch_and_ingest_resumes(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(3).write.parquet(source)
    seen = []
    merge = lambda df, n: seen.append(events.dedup(df, ["event_id"]).count())
    ddl = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    for _ in range(2):
        events.ingest(spark, source, ddl, merge, checkpoint).awaitTermination(120)
    assert sum(seen) == rows.count()
    stream = events.tumbling(spark.readStream.schema(ddl).parquet(source), "1 hour")
    run = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = {(r.event_type, r.start): r.n for r in events.tumbling(rows, "1 hour").collect()}
    assert {(r.event_type, r.start): r.n for r in spark.table("tumbled").collect()} == batch
