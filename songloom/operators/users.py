"""User tables: history, playlists, playlist tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom import fixed
from songloom.operators.ranking import first_per_key, group_rank, top_per_key


def with_defaults(history: DataFrame) -> DataFrame:
    """Default artist, model and result count of a history row."""
    return history.fillna({"query_artist": "", "model_used": "model1", "results_count": 0})


def known_users(history: DataFrame, users: DataFrame, user_key: str) -> DataFrame:
    """History rows of existing users only."""
    return history.join(users.select(F.col(user_key).alias("user_id")), "user_id", "left_semi")


def latest(history: DataFrame, limit: int = 50) -> DataFrame:
    """Newest rows per user."""
    lo, hi = fixed.HISTORY_LIMITS
    if not lo <= limit <= hi:
        raise ValueError(f"limit {limit} is outside {fixed.HISTORY_LIMITS}")
    return top_per_key(history, ["user_id"], [F.desc("searched_at"), F.desc("id")], limit)


def recent_distinct(history: DataFrame, k: int = 10) -> DataFrame:
    """Last distinct queries per user in any case, newest first."""
    last = history.groupBy(
        "user_id", F.lower("query_song").alias("song"), F.lower(F.coalesce("query_artist", F.lit(""))).alias("artist")
    ).agg(F.max(F.struct("searched_at", "id")).alias("at"))
    ranked = top_per_key(last, ["user_id"], [F.desc("at")], k)
    return ranked.select("user_id", "song", "artist", F.col("at.id").alias("last_id"), "rank")


def without(history: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Rows left after deletion by key."""
    return history.join(gone, on, "left_anti")


def snapshot(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Current rows of a change log: latest wins, deleted ones vanish."""
    return first_per_key(changes, [key], order, last=True).filter(F.col("op") != "delete")


def track_counts(playlists: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """Playlists with their number of tracks, zero included."""
    counts = tracks.groupBy(key).agg(F.count("*").alias("track_count"))
    return playlists.join(counts, key, "left").withColumn("track_count", F.coalesce("track_count", F.lit(0)))


def last_positions(playlists: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """Position the next track of each playlist will get."""
    last = tracks.groupBy(key).agg(F.max("position").alias("last"))
    return playlists.join(last, key, "left").select(
        key, (F.coalesce("last", F.lit(-1)) + 1).cast("bigint").alias("next_position")
    )


def append_tracks(tracks: DataFrame, added: DataFrame, key: str, order: list[str], chunk: Column) -> DataFrame:
    """Positions of added tracks, counted on from the last one per playlist."""
    last = tracks.groupBy(key).agg(F.max("position").alias("last"))
    placed = group_rank(added, [key], order, chunk, "place").drop("group_size")
    return (
        placed.join(last, key, "left")
        .withColumn("position", (F.coalesce("last", F.lit(-1)) + 1 + F.col("place")).cast("bigint"))
        .drop("last", "place")
    )


def last_touched(playlists: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """``updated_at`` moved on by the newest track of the playlist."""
    newest = tracks.groupBy(key).agg(F.max("added_at").alias("newest"))
    return playlists.join(newest, key, "left").withColumn("updated_at", F.greatest("updated_at", "newest")).drop("newest")


def children_left(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows that survive the deletion of their parents."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def violations(batch: DataFrame, existing: DataFrame, column: str) -> DataFrame:
    """Values of a batch that are taken already or occur twice within it."""
    counts = batch.groupBy(column).agg(F.count("*").alias("times"))
    taken = existing.select(column).distinct().withColumn("taken", F.lit(True))
    return (
        counts.join(taken, column, "left")
        .withColumn("taken", F.coalesce("taken", F.lit(False)))
        .filter(F.col("taken") | (F.col("times") > 1))
    )


def text_length_check(value: Column, low: int, high: int) -> Column:
    """Why a name is refused: too short, too long, or null when it is fine."""
    size = F.length(F.trim(value))
    return F.when(size < low, F.lit("too short")).when(size > high, F.lit("too long"))
