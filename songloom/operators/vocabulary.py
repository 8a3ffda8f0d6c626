"""Vocabularies: fit, apply, label encoders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.operators.ranking import global_rank

UNKNOWN = "<UNK>"


def fit_first_seen(df: DataFrame, column: str, pos: str) -> DataFrame:
    """(value, idx) in order of first appearance; the unknown token is last."""
    seen = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(pos).alias("_pos"))
    ranked = global_rank(seen, ["_pos", "value"], "_rank").select("value", (F.col("_rank") - 1).alias("idx"))
    unknown = seen.agg(F.count("*").alias("idx")).select(F.lit(UNKNOWN).alias("value"), "idx")
    return ranked.unionByName(unknown)


def fit_sorted(df: DataFrame, column: str) -> DataFrame:
    """(value, idx) in sorted order, a missing value counting as Unknown."""
    values = df.select(F.coalesce(F.col(column), F.lit("Unknown")).alias("value")).distinct()
    return global_rank(values, ["value"], "_rank").select("value", (F.col("_rank") - 1).alias("idx"))


def apply_vocabulary(df: DataFrame, vocabulary: DataFrame, column: str, out: str, unknown: int | None = None) -> DataFrame:
    """Index of each value; an unknown one gets ``unknown`` or the last index.

    A plain left join: Spark broadcasts the vocabulary only while it is small.
    """
    known = vocabulary.select(F.col("value").alias(column), F.col("idx").alias("_idx"))
    joined = df.join(known, column, "left")
    if unknown is not None:
        return joined.withColumn(out, F.coalesce("_idx", F.lit(unknown))).drop("_idx")
    last = vocabulary.filter(F.col("value") == UNKNOWN).select("idx").scalar()
    return joined.withColumn(out, F.coalesce("_idx", last)).drop("_idx")
