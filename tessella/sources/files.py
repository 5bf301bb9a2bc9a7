"""Readers and writers of the record formats: JSON lines, JSON, CSV of unknown encoding, Markdown and PDF folders, record stores."""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessella.session import delete_path

ENCODINGS = ("UTF-8", "GBK", "GB2312", "GB18030", "ISO-8859-1")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object a line. Strict: a line that is none fails the query; else it is left out (and a byte-order mark is ignored)."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\x{feff}", "").alias("value"))
    rows = lines.where(F.trim("value").startswith("{")).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v"))
    return rows.where("v is not null").select("r.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A top-level array, or one object, in each file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _csv_rows(encodings: tuple[str, ...], most: int | None):
    """(path, line, cells) of whole files, each in the first encoding that decodes all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                for encoding in encodings:
                    try:
                        text = data.decode("utf-8-sig" if encoding == "UTF-8" else encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    raise ValueError(f"no encoding of {encodings} decodes {path}")
                cells = list(itertools.islice(csv.reader(io.StringIO(text, newline="")), most))
                for at in range(0, len(cells), 10_000):
                    part = cells[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string()))], names=["path", "line", "cells"])

    return run


def read_csv(spark: SparkSession, path: str, rows: int | None = None, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """CSV files with a header, each in the first encoding that decodes all of it; quoted line feeds are kept.

    A file is read by one task, up to the 2 GB that one value can hold; the
    header is that of the first file by path. Empty cells are null.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = "path string, line long, cells array<string>"
    head = files.mapInArrow(_csv_rows(encodings, 1), kind).orderBy("path", "line").first()
    names = head.cells if head else []
    body = files.mapInArrow(_csv_rows(encodings, None), kind).where("line > 0")
    body = body.orderBy("path", "line").limit(rows) if rows else body
    return body.select(*[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def sniff_columns(names: list[str], wanted: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """For each wanted role the first column whose lower-case name holds one of its words; roles without one are left out."""
    return {role: hit[0] for role, words in wanted.items() if (hit := [n for n in names if any(w in n.lower() for w in words)])}


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Dispatch on the suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix in ("jsonl", "ndjson"):
        return read_jsonl(spark, path, schema, strict=False)
    if suffix == "json":
        return read_json(spark, path, schema)
    raise ValueError(f"unknown kind of file: {path}")


def read_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(path, line, value): lines with their number from 1, the first ``limit`` of each file if that is given.

    Files are read in splits; a split's first number comes from the counts of
    those before it, one row a split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("path", "block").count()
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = lines.withColumn("n", F.row_number().over(Window.partitionBy("path", "block").orderBy("at")))
    out = own.join(starts, ["path", "block"]).select("path", (F.col("start") + F.col("n")).alias("line"), "value")
    return out.where(F.col("line") <= limit) if limit else out


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source, text) of the Markdown files of a folder."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    path = F.input_file_name()
    return files.select(path.alias("path"), F.regexp_extract(path, r"([^/]+)\.md$", 1).alias("source"), F.col("value").alias("text"))


def write_jsonl(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Rows as JSON lines under Spark's commit protocol; returns how many."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)
    return df.sparkSession.read.text(path).count()


def write_capped(df: DataFrame, path: str, cap: int, order: list[Column]) -> dict:
    """The first ``cap`` rows in ``order`` as JSON lines; says how many there were."""
    total = df.count()
    df.orderBy(*order).limit(cap).write.mode("overwrite").json(path)
    return {"total": total, "written": min(cap, total), "truncated": total > cap}


def write_sinks(df: DataFrame, path: str, sink: str, sinks: list[str], cap: int | None = None, order: list[Column] = ()) -> dict[str, dict]:
    """Rows as JSON lines, a folder ``sink=<name>`` for each sink; says of each how many rows there were and how many were kept.

    The managed ``sinks`` are reset first, so that one without rows is left
    empty rather than with what it held; rows of other sinks are not written,
    and counted under None. ``df`` is read once: all counts come from one
    observation of that read, and ``cap`` keeps the first rows of each sink in
    ``order``, ranked within each task before they are shuffled.
    """
    spark = df.sparkSession
    name = F.col(sink).cast("string")
    for known in sinks:
        delete_path(spark, f"{path.rstrip('/')}/{sink}={known}")
    seen = Observation()
    counts = [F.count_if(name == known).alias(f"n{i}") for i, known in enumerate(sinks)]
    kept = df.observe(seen, F.count(F.lit(1)).alias("all"), *counts).where(name.isin(*sinks) if sinks else F.lit(False))
    if cap is not None:
        kept = kept.withColumn("_place", F.row_number().over(Window.partitionBy(sink).orderBy(*order))).where(F.col("_place") <= cap).drop("_place")
    kept.write.mode("append").partitionBy(sink).json(path)
    n = {known: seen.get[f"n{i}"] for i, known in enumerate(sinks)}
    out = {known: {"total": n[known], "written": n[known] if cap is None else min(cap, n[known]), "truncated": cap is not None and n[known] > cap} for known in sinks}
    return out | {None: {"total": seen.get["all"] - sum(n.values()), "written": 0, "truncated": False}}


def replace_table(df: DataFrame, path: str) -> int:
    """Rebuild aside, verify the count, then swap: the old table is renamed aside, and back if the new one cannot take its place.

    ``df`` is computed once. Between two renames a reader may find no table;
    it never finds a part of one.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    aside, old = f"{path}.rebuild", f"{path}.old"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(aside)
    wanted, got = seen.get["n"], spark.read.schema(df.schema).parquet(aside).count()
    if wanted != got:
        raise RuntimeError(f"{aside} has {got} rows of {wanted}")
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = jpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    delete_path(spark, old)
    had = files.exists(jpath(path))
    if had and not files.rename(jpath(path), jpath(old)):
        raise RuntimeError(f"{path} could not be set aside")
    if not files.rename(jpath(aside), jpath(path)):
        if had:
            files.rename(jpath(old), jpath(path))
        raise RuntimeError(f"{aside} could not take the place of {path}")
    delete_path(spark, old)
    return got


class ParentStore:
    """Parents by id, as a Parquet table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, parents: DataFrame) -> None:
        """``parents``: parent_id, content. Later ones replace those of their id when read."""
        parents.select("parent_id", "content", F.current_timestamp().alias("saved")).write.mode("append").parquet(self.path)

    def load(self, ids: DataFrame) -> DataFrame:
        """(parent_id, content) of the distinct ``ids``, by their trailing number."""
        newest = self.spark.read.parquet(self.path).join(ids.select("parent_id").distinct(), "parent_id", "left_semi").groupBy("parent_id").agg(F.max_by("content", "saved").alias("content"))
        return newest.orderBy(F.regexp_extract("parent_id", r"_parent_(\d+)$", 1).try_cast("int"), "parent_id")

    def clear(self) -> None:
        delete_path(self.spark, self.path)


def render_dialogue(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, markdown): the turns of each conversation as a Markdown document."""
    title = {"user": "**User:** ", "assistant": "**Assistant:** "}
    head = F.when(F.col("role") == "user", title["user"]).when(F.col("role") == "assistant", title["assistant"]).otherwise(F.concat(F.lit("**"), F.col("role"), F.lit(":** ")))
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(head, F.coalesce("text", F.lit(""))).alias("line")))).alias("t"))
    return rows.select(key, F.array_join("t.line", "\n\n").alias("markdown"))
