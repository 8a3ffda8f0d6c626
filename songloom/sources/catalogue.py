"""How the given tables stand in for a track catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom import fixed
from songloom.sources.readers import Tables


def emotion_by_number(n: Column) -> Column:
    labels = F.array(*[F.lit(x) for x in fixed.EMOTIONS])
    return F.element_at(labels, (n % len(fixed.EMOTIONS) + 1).cast("int"))


def track_id() -> Column:
    """Order and line number repeat, so the id names the whole line."""
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)


def tracks(t: Tables) -> DataFrame:
    """One row per track: names, emotion, popularity and the nine features.

    The two dimension tables are joined with plain equi joins: Spark broadcasts
    them while they are small and shuffles, splitting hot keys, once they are not.
    """
    joined = t.spread("lineitem", "l_orderkey").join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(
        t.supplier, F.col("l_suppkey") == F.col("s_suppkey")
    )
    return joined.select(
        track_id().alias("track_id"),
        F.col("p_name").alias("song"),
        F.col("s_name").alias("artist"),
        F.col("p_type").alias("genre"),
        F.col("p_brand").alias("album"),
        emotion_by_number(F.col("l_linenumber")).alias("emotion"),
        F.col("p_retailprice").alias("popularity"),
        (F.col("l_quantity") / 50).alias("energy"),
        (F.col("l_tax") * 12.5).alias("danceability"),
        (F.col("l_discount") * 10).alias("valence"),
        F.col("l_extendedprice").alias("tempo"),
        (F.col("p_size") / 50).alias("acousticness"),
        (F.col("s_nationkey") / 24).alias("instrumentalness"),
        (F.col("l_linenumber") / 7).alias("speechiness"),
        (F.abs("s_acctbal") / 10000).alias("liveness"),
        (F.col("l_suppkey") % 12 / 11).alias("key"),
        F.col("l_shipdate").alias("release_date"),
        (F.col("l_extendedprice") * 3).alias("length_ms"),
    )


def raw_tracks(t: Tables) -> DataFrame:
    """Tracks as first collected: percent scales, a zero standing for missing."""
    return t.spread("lineitem", "l_orderkey").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        track_id().alias("track_id"),
        F.col("p_name").alias("song"),
        F.col("l_quantity").alias("energy"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("danceability"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("valence"),
        F.col("l_extendedprice").alias("tempo"),
    )


def songs(t: Tables) -> DataFrame:
    """The named-song table: one row per part."""
    return t.part.select(
        F.col("p_partkey").alias("pos"),
        F.col("p_name").alias("song"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("genre"),
        emotion_by_number(F.col("p_size")).alias("emotion"),
        F.col("p_retailprice").alias("popularity"),
    )


def lyrics(t: Tables) -> DataFrame:
    """Lyrics with their optional labels; most rows carry none."""
    return t.spread("documents", "doc_id").join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.col("source").alias("artist"),
        F.col("lang").alias("genre"),
        F.col("text").alias("lyrics"),
        "n_chars",
        "quality",
        "toxic",
    )


def song_vectors(t: Tables) -> DataFrame:
    """Catalogue songs that have an embedding."""
    named = songs(t).drop("emotion", "popularity")
    return t.spread("embeddings", "vec_id").join(named, F.col("vec_id") == F.col("pos")).select(
        F.col("vec_id").alias("id"),
        "song",
        "artist",
        "genre",
        emotion_by_number(F.col("label")).alias("emotion"),
        "embedding",
    )
