"""Harmonising, merging and enriching song tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions.numeric import is_missing, parse_loudness, to_number, wrap
from songloom.operators.ranking import first_per_key
from songloom.operators.statistics import rescale_percent


def harmonise_names(df: DataFrame) -> DataFrame:
    """Rename raw columns whose harmonised name is still free."""
    have = set(df.columns)
    return df.withColumnsRenamed({a: b for a, b in fixed.COLUMN_NAMES.items() if a in have and b not in have})


def resolve_alias(df: DataFrame, aliases: list[str], fallback: int) -> str:
    """First alias that the table has, else the column at a position."""
    for name in aliases:
        if name in df.columns:
            return name
    return df.columns[min(fallback, len(df.columns) - 1)]


def song_column(df: DataFrame) -> str:
    return resolve_alias(df, fixed.SONG_ALIASES, 0)


def artist_column(df: DataFrame) -> str:
    return resolve_alias(df, fixed.ARTIST_ALIASES, 1)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {gone}")
    return df


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c)) for c in columns if c in df.columns})


def harmonise_features(df: DataFrame) -> DataFrame:
    """Raw feature text to numbers: loudness suffix, key and mode wrap, scales."""
    out = {}
    if "loudness" in df.columns:
        out["loudness"] = parse_loudness(F.col("loudness").cast("string"))
    if "key" in df.columns:
        out["key"] = wrap(F.col("key"), 12)
    if "mode" in df.columns:
        out["mode"] = wrap(F.col("mode"), 2)
    numbers = coerce_numbers(df.withColumns(out), [*fixed.UNIT_FEATURES, "tempo"])
    present = [c for c in fixed.UNIT_FEATURES if c in df.columns]
    return rescale_percent(numbers, present) if present else numbers


def unseen_rows(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Secondary rows whose key the primary table lacks; copies inside stay."""
    return secondary.join(primary.select(key).distinct(), key, "left_anti")


def union_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both tables on the columns they share, in the order of the left one."""
    common = [c for c in left.columns if c in set(right.columns)]
    return left.select(*common).unionByName(right.select(*common))


def new_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in right.columns if c not in set(left.columns)]


def enrich(df: DataFrame, lookup: DataFrame, key: str, features: list[str], order: list[str]) -> DataFrame:
    """Fill missing features from the first lookup row of the same key."""
    first = first_per_key(lookup.select(key, *order, *[c for c in features if c not in order]), [key], order)
    side = first.select(key, *[F.col(c).alias(f"_{c}") for c in features])

    def filled(c: str) -> Column:
        if c not in df.columns:
            return F.col(f"_{c}")
        return F.when(is_missing(F.col(c)), F.col(f"_{c}")).otherwise(F.col(c))

    return df.join(side, key, "left").withColumns({c: filled(c) for c in features}).drop(*[f"_{c}" for c in features])


def valid_text(df: DataFrame, column: str, longer_than: int = 50) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.length(column) > longer_than))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that still wait for their vector."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
