"""The feature encoder as an artefact: fitted once, saved, loaded, applied anywhere.

An encoder is a few numbers per feature: mean, deviation and weights on the
axes. They enter a plan as constants, so encoding is plain arithmetic that
Spark compiles into the scan: no join, no shuffle and no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions.numeric import is_missing, zscore
from songloom.functions.vectors import project
from songloom.operators import statistics as S
from songloom.operators.ranking import top_per_key
from songloom.session import cut_lineage

BUCKETS = 500  # of distance 1; nearest() counts rows by bucket
SCHEMA = "place int, feature string, mean double, std double, weights array<double>"


@dataclass(frozen=True)
class Encoder:
    """Means and deviations per feature, and its weight on each axis."""

    features: list[str]
    means: list[float]
    stds: list[float]
    weights: list[list[float]]

    @property
    def axes(self) -> list[list[float]]:
        return [list(axis) for axis in zip(*self.weights)]

    def scaled(self, df: DataFrame) -> DataFrame:
        """Features as z-scores; a NaN counts as null."""
        return df.withColumns(
            {f: F.when(~is_missing(F.col(f).cast("double")), zscore(F.col(f), F.lit(m), F.lit(s)))
             for f, m, s in zip(self.features, self.means, self.stds)}
        )

    def coded(self, df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
        """The table with z-scores, codes and the codes' length, and the names of z-scores and codes.

        A missing feature becomes NaN, and so do all codes and the length: columns that are never null
        keep the compiled arithmetic short.
        """
        scores, names = [f"_z{i}" for i in range(len(self.features))], [f"_c{i}" for i in range(len(self.axes))]
        z = {
            name: (F.coalesce(F.col(f).cast("double"), F.lit(math.nan)) - m) * (1.0 / (s + fixed.EPSILON))
            for name, f, m, s in zip(scores, self.features, self.means, self.stds)
        }
        rows = df.withColumns(z).withColumns(dict(zip(names, project(scores, self.axes))))
        square = F.lit(0.0)
        for c in names:
            square = square + F.col(c) * F.col(c)
        return rows.withColumn("_length", F.sqrt(square)), scores, names

    def encode(self, df: DataFrame, id_col: str) -> DataFrame:
        """(id, embedding, mse): code of length one, and mean squared error of the z-scores rebuilt from the code.

        A zero code stays. A row that lacks a feature, or has an infinite one,
        keeps its place with null in both.
        """
        rows, scores, names = self.coded(df)
        error = F.lit(0.0)
        for z, back in zip(scores, project(names, self.weights)):
            error = error + (F.col(z) - back) * (F.col(z) - back)
        measured = rows.withColumns({"_error": error / len(self.features), "_divisor": F.when(F.col("_length") > 0, F.col("_length")).otherwise(1.0)})
        there = ~F.isnan("_error") & (F.col("_length") < float("inf"))
        embedding = F.array(*[(F.col(c) / F.col("_divisor")).cast("float") for c in names])
        return measured.select(id_col, F.when(there, embedding).alias("embedding"), F.when(there, F.col("_error")).alias("mse"))

    def codes_of(self, values: list[float]) -> list[float]:
        """The unit code of one row given as plain numbers, as ``encode`` gives it."""
        z = (np.array(values) - self.means) / (np.array(self.stds) + fixed.EPSILON)
        code = z @ np.array(self.weights)
        return (code / (np.linalg.norm(code) or 1.0)).tolist()

    def save(self, spark: SparkSession, folder: str) -> None:
        """Write one row per feature; an encoder is never overwritten."""
        rows = list(zip(range(len(self.features)), self.features, self.means, self.stds, self.weights))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)


def load(spark: SparkSession, folder: str) -> Encoder:
    rows = spark.read.schema(SCHEMA).parquet(folder).orderBy("place").collect()  # one row per feature
    return Encoder([r.feature for r in rows], [r["mean"] for r in rows], [r["std"] for r in rows], [list(r.weights) for r in rows])


def fit(df: DataFrame, k: int, features: list[str] = fixed.FEATURES, population: bool = False) -> Encoder:
    """The first ``k`` principal axes of the z-scored features.

    The covariance of z-scores is the correlation matrix, so two one-row
    aggregates are all that leaves the tasks. The first weight of an axis that
    is not near zero is positive. A feature without spread has no weight.
    """
    numbers = df.select(*[F.when(~is_missing(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features])
    facts = S.column_facts(numbers, features, population)
    place = {name: i for i, name in enumerate(features)}
    table = np.zeros((len(place), len(place)))
    for row in S.correlations(numbers, features, facts=facts).collect():
        table[place[row["feature_a"]], place[row["feature_b"]]] = row["corr"] or 0.0
    values, axes = np.linalg.eigh((table + table.T) / 2)
    axes = axes[:, np.argsort(values)[::-1][:k]]
    lead = (np.abs(axes) > 0.01).argmax(0)
    axes = axes * np.sign(axes[lead, np.arange(axes.shape[1])])
    return Encoder(
        list(features), [facts[f]["mean"] or 0.0 for f in features], [facts[f]["std"] or 0.0 for f in features], axes.tolist()
    )


def fit_scaler(df: DataFrame, features: list[str] = fixed.FEATURES, population: bool = False) -> Encoder:
    """An encoder whose axes are the z-scored features themselves."""
    facts = S.column_facts(df, features, population)
    return Encoder(
        list(features), [facts[f]["mean"] or 0.0 for f in features], [facts[f]["std"] or 0.0 for f in features],
        np.eye(len(features)).tolist(),
    )


def nearest(df: DataFrame, id_col: str, encoder: Encoder, targets: dict[str, list[float]], k: int) -> DataFrame:
    """The ``k`` rows nearest to each of a few fixed targets by cosine of codes.

    (query_id, neighbour_id, similarity, rank), ties by id. A target costs one
    sum of products with constants per row; ids and distances are written once.
    A first pass over them counts rows by bucket of distance; a second keeps
    only rows in a bucket among the nearest k, so nothing large is sorted. A row that lacks a feature, or has an
    infinite one, takes no part.
    """
    rows, scores, names = encoder.coded(df)
    divisor = F.when(F.col("_length") > 0, F.col("_length")).otherwise(1.0)
    gaps = {}
    for place, values in enumerate(targets.values()):
        along = F.lit(0.0)
        # back to the z-scores, so that a target costs no more with many axes
        for z, weight in zip(scores, np.array(encoder.weights) @ encoder.codes_of(values)):
            along = along + F.col(z) * F.lit(float(weight))
        gaps[f"_d{place}"] = F.round(F.lit(2.0) - F.lit(2.0) * along / F.col("_divisor"), 9)
    measured = cut_lineage(
        rows.withColumn("_divisor", divisor).withColumns(gaps).select(F.col(id_col).alias("neighbour_id"), F.array(*gaps).alias("gaps")), "measured"
    )

    long = measured.select("neighbour_id", F.posexplode("gaps").alias("place", "distance")).filter(~F.isnan("distance"))
    bucket = F.floor(F.col("distance") * BUCKETS)
    counts = long.groupBy("place", bucket.alias("bucket")).agg(F.count("*").alias("rows"))
    # few rows: as many buckets as a distance has, for each target
    nearer = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("nearer", F.coalesce(F.sum("rows").over(nearer), F.lit(0))).filter(F.col("nearer") < k)
    last = {r["place"]: r["last"] for r in reached.groupBy("place").agg(F.max("bucket").alias("last")).collect()}

    def of_target(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("place") + 1)

    near = long.filter(bucket <= of_target([last.get(i, -1) for i in range(len(targets))])).select(
        of_target(list(targets)).alias("query_id"), "neighbour_id", "distance"
    )
    ranked = top_per_key(near, ["query_id"], [F.col("distance"), F.col("neighbour_id")], k)
    return ranked.select("query_id", "neighbour_id", (F.lit(1.0) - F.col("distance") / 2).alias("similarity"), "rank")
