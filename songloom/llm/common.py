"""Small helpers that several operators share."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.session import cut_lineage, scratch_path, shared_dir

__all__ = ["crc_mod", "cut_lineage", "drop_folder", "fnum", "parts_of", "read_table", "scratch_path", "shared_dir", "texts_of"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key written as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % n


def fnum(spark: SparkSession, key: str, default: int) -> int:
    """A numeric setting of the session."""
    return int(spark.conf.get(key, str(default)))


def parts_of(df: DataFrame) -> int:
    """Parts for a shuffle whose size follows the input: its splits, or the session's number if that is larger."""
    return max(df.rdd.getNumPartitions(), fnum(df.sparkSession, "spark.sql.shuffle.partitions", 200))


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null reads as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stable_hash(words: Iterable[str]) -> np.ndarray:
    """The same 32-bit number for a word in every process."""
    return np.fromiter((zlib.crc32(w.encode()) for w in words), dtype=np.uint32)


def in_pieces(items: list, size: int) -> Iterator[list]:
    for a in range(0, len(items), size):
        yield items[a : a + size]
