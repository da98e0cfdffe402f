"""Spark sessions for tests, the bench and the shell.  On a cluster the caller brings the session."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cpus: int | None = None, name: str = "palimpsest") -> SparkSession:
    """A local session with the settings that the library assumes: UTC, AQE, few shuffle partitions."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PALIMPSEST_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One table of a data directory; the path is read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` or the context names it.  Only a local master
    goes on without one, with a temporary folder; on a cluster that would be each machine's own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "palimpsest-checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def numbered(rows: DataFrame, name: str, *by: str, first: int = 0) -> DataFrame:
    """Rows numbered in the order of unique columns, from ``first`` on: ranges are ranked apart, each after the rows of those
    before it, so no task sees all rows.  The driver sees one number per range."""
    dealt = cut(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())
    starts, at = [], first
    for part, n in sizes:
        starts.append((part, at))
        at += n
    before = F.broadcast(dealt.sparkSession.createDataFrame(starts, "_range int, _start long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return dealt.withColumn(name, place).join(before, "_range").withColumn(name, F.col(name) + F.col("_start") - 1).drop("_range", "_start")


def fingerprint(df: DataFrame) -> str:
    """Names the files that a table is read from, with their sizes and times, so that what is derived from them can be kept
    until they change."""
    spark = df.sparkSession
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    seen = hashlib.sha1()
    for name in sorted(df.inputFiles()):
        at = path(name)
        status = at.getFileSystem(conf).getFileStatus(at)
        seen.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return seen.hexdigest()
