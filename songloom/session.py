"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "songloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    Shuffle sizing is left to adaptive execution: start from many partitions
    and let Spark coalesce them, split skewed ones and switch join strategies.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A temporary folder is used only for a local master with no setting.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = os.path.join(tempfile.gettempdir(), f"songloom-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for an intermediate table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "step", folder: str | None = None) -> DataFrame:
    """The rows as a table written to the shared folder.

    Later jobs read that table, so nothing before it runs again, also when
    executors are lost. In a ``folder`` of the caller's, who drops it when it
    is no longer read, the table is packed tighter.
    """
    path = f"{folder}/{name}" if folder else scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd") if folder else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove tables that no plan reads any more, through Spark's own file system layer."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the files of a job's shuffles go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spread(table: DataFrame, key: str, most: int = 64) -> DataFrame:
    """A scanned table in at least as many parts as there are cores.

    Large tables already are, and stay as they are. Only a table with few
    input splits is dealt out by a unique key, so that costly row work uses
    all cores.
    """
    cores = min(table.sparkSession.sparkContext.defaultParallelism, most)
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, key)
