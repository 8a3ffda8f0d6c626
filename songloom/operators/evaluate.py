"""Classifier metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then both averages.

    The table is folded to its confusion counts first; all else is tiny.
    """
    confusion = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("rows"))
    hit = F.when(F.col("y") == F.col("p"), F.col("rows")).otherwise(0)
    views = F.array(
        F.struct(F.col("y").cast("string").alias("name"), F.col("rows").alias("support"), F.lit(0).cast("bigint").alias("called"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("p").cast("string").alias("name"), F.lit(0).cast("bigint").alias("support"), F.col("rows").alias("called"), F.lit(0).cast("bigint").alias("hits")),
    )
    sums = confusion.select(F.inline(views)).groupBy("name").agg(*[F.sum(c).alias(c) for c in ("support", "called", "hits")])
    per_class = sums.select(
        "name", ratio(F.col("hits"), F.col("called")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), "support"
    ).withColumn("f1", ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")))
    scores = ("precision", "recall", "f1")
    macro = per_class.agg(F.lit("macro avg").alias("name"), *[F.avg(c).alias(c) for c in scores], F.sum("support").alias("support"))
    weighted = per_class.agg(
        F.lit("weighted avg").alias("name"),
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in scores],
        F.sum("support").alias("support"),
    )
    return per_class.select(*macro.columns).unionByName(macro).unionByName(weighted)
