"""Sinks: Parquet for tables and vectors, CSV splits, small JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}  # for large CSV: about 0.37 of the bytes in about the same time


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_vectors(df: DataFrame, path: str, id_col: str, vector: Column) -> None:
    """Id and ``array<float>`` vector side by side, so no position ever matters."""
    df.select(F.col(id_col), vector.cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def write_csv_splits(df: DataFrame, path: str, split_col: str = "split", packed: bool = False) -> None:
    """One CSV dataset with a folder per split; its files are gzip if ``packed``."""
    df.write.mode("overwrite").options(**(PACKED if packed else {})).partitionBy(split_col).csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_small_json(summary: DataFrame, path: str) -> None:
    """A one-row summary (statistics, dataset facts, vocabulary) as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def lite_metadata(df: DataFrame) -> DataFrame:
    """Only the columns that search results show."""
    return df.select("song", "artist", "genre", "emotion")
