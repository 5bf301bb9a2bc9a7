"""Session defaults, and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword arguments are further settings, with ``__`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a temporary folder for a local master, or else the warehouse if it is no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.conf.get("spark.tessella.sharedDir", None)
    if not own:
        local = spark.sparkContext.master.startswith("local")
        own = "file://" + tempfile.mkdtemp(prefix="tessella-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not local and own.startswith(("file:", "/", "spark-warehouse")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is a folder of each machine's own")
        spark.conf.set("spark.tessella.sharedDir", own)
    return own


def scratch_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder. Its file system removes it when the application ends."""
    path = f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}"
    if spark.conf.get("spark.tessella.scratchDir", None) != path:
        target, files = _hadoop(spark, path)
        files.mkdirs(target)
        files.deleteOnExit(target)
        spark.conf.set("spark.tessella.scratchDir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def broadcast_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; it is counted, so it should be a written table of narrow rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, as Java objects."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage so that a lost executor costs only the reading of files, and
    gives the planner the true size of the table: small ones are then
    broadcast on measured bytes rather than on a guess.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table."""
    target, files = _hadoop(spark, path)
    files.delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that still read them are lost."""
    delete_path(spark, scratch_dir(spark))


def drop_scratch(df: DataFrame) -> None:
    """Remove the files of a materialized table."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_path(df.sparkSession, folder)
