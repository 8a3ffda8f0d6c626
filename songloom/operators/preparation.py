"""The preparation job: raw sources to written, split training tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.operators import prepare, ranking
from songloom.operators import statistics as S
from songloom.session import cut_lineage
from songloom.sources import sinks
from songloom.sources.readers import read_csv


def harmonised(df: DataFrame, required: list[str]) -> DataFrame:
    """A raw source under the common names and in the common units; an error names the columns it lacks."""
    named = prepare.harmonise_names(df)
    found = {prepare.song_column(named): "song", prepare.artist_column(named): "artist"}
    named = named.withColumnsRenamed({a: b for a, b in found.items() if b not in named.columns})
    return prepare.harmonise_features(prepare.require_columns(named, required))


def prepared(
    primary: DataFrame,
    secondary: DataFrame,
    lookup: DataFrame,
    merge_key: Column,
    lookup_key: Column,
    order: str,
    id_col: str,
    features: list[str],
    required: list[str],
    scratch: str,
    names: tuple[str, ...] = ("song", "artist"),
    tail: float = 0.2,
) -> DataFrame:
    """One table of ``id_col``, ``names``, ``emotion``, ``features`` and ``split``.

    Secondary rows join where their merge key is new, on the columns both have.
    Features that are missing are filled from the lookup's first row (by
    ``order``) of the same key, whole columns it alone has are added, and what
    is still missing gets the median. A null emotion becomes neutral. Parts are
    exact within each emotion. Ids must be unique; texts stay out of all
    shuffles but those of their own keys.

    The enriched rows are the one table that is written, into the folder
    ``scratch``, which the caller drops when the result has been read; neither
    source is read again. Medians and cuts are constants of the plan, so later
    steps are worked out in each reading of that table.
    """
    # 16 bytes of digest instead of its 32 digits, as keys make up much of what the merge shuffles
    left, right = (harmonised(df, required).withColumn("_key", F.unhex(F.md5(merge_key))) for df in (primary, secondary))
    merged = prepare.union_common(left, prepare.unseen_rows(left, right, "_key")).drop("_key")
    side = lookup.withColumn("_lookup", lookup_key)
    fill = [f for f in features if f in lookup.columns and f in merged.columns]
    fill += [f for f in prepare.new_columns(merged, lookup) if f in features]
    # the lookup's first rows as a table, so that its size is known: while it is small, the merged rows are not shuffled to meet it
    side = cut_lineage(ranking.first_per_key(side.select("_lookup", F.col(order).alias("_order"), *fill), ["_lookup"], ["_order"]), "lookup", scratch)
    rich = prepare.enrich(merged.withColumn("_lookup", lookup_key), side, "_lookup", fill, ["_order"]).drop("_lookup")
    prepare.require_columns(rich, features)
    # read by the medians, the split and the writers
    rich = cut_lineage(rich.select(id_col, *names, "emotion", *features), "enriched", scratch)
    whole = S.impute_median(rich, features, kept=True).fillna({"emotion": "neutral"})
    return ranking.exact_split(whole, id_col, ranking.halved_tail_sizes(tail), ["emotion"], kept=True)


def write(df: DataFrame, folder: str, features: list[str]) -> None:
    """Packed CSV by split, and the training part's feature statistics as JSON; the folder tells all a reader needs.

    ``df`` is read twice, as the result of ``prepared`` can be.
    """
    sinks.write_csv_splits(df, f"{folder}/splits", packed=True)
    sinks.write_small_json(S.fit_long(df.filter("split = 'train'"), features, population=False), f"{folder}/statistics")


def written(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return read_csv(spark, f"{folder}/splits", f"{schema}, split string", multi_line=False)


def written_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("feature string, mean double, std double, min double, max double").json(f"{folder}/statistics")
