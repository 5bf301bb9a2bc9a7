"""Readers of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder (a Parquet file or a folder of them)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files."""
    folder, table = sf_dir.rstrip("/"), f"{name}.parquet"
    schema = load(spark, sf_dir, name).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    # A stream reads folders; a table of one file is picked out of its folder by name.
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{folder}/{table}") if status.isDirectory() else reader.option("pathGlobFilter", table).parquet(folder)
