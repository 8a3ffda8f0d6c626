"""Mood, context and label queries over the track table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions.numeric import lookup
from songloom.operators.encoder import Encoder, fit_scaler, nearest
from songloom.operators.ranking import top_per_key
from songloom.operators.search import check_limit, relative_scores

POOL = 100
LABEL_POOL = 50


def fits_mood(mood: str) -> Column:
    """The rule of one mood: emotion list and closed valence / energy ranges."""
    emotions, (v0, v1), (e0, e1) = fixed.MOOD_RULES[mood]
    rule = F.col("valence").between(v0, v1) & F.col("energy").between(e0, e1)
    return F.col("emotion").isin(emotions) & rule if emotions else rule


def check_mood(mood: str) -> str:
    if mood.lower() not in fixed.MOOD_RULES:
        raise ValueError(f"unknown mood: {mood}")
    return mood.lower()


def check_context(context: str) -> str:
    if context.lower() not in fixed.CONTEXT_MOODS:
        raise ValueError(f"unknown context: {context}")
    return context.lower()


def resolve_mood(label: Column) -> Column:
    """Known mood in lower case, any other label counts as happy."""
    name = F.lower(label)
    return F.when(name.isin(list(fixed.MOOD_RULES)), name).otherwise(F.lit("happy"))


def resolve_context(label: Column) -> Column:
    return F.coalesce(lookup(fixed.CONTEXT_MOODS, F.lower(label)), F.lit("happy"))


def resolve_profile(label: Column) -> Column:
    """Known profile label, any other one counts as Calm."""
    name = F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, F.lit(2), F.length(label))))
    return F.when(name.isin(list(fixed.LABEL_PROFILES)), name).otherwise(F.lit("Calm"))


def by_every_mood(tracks: DataFrame) -> DataFrame:
    """Each track once per mood it fits; the rules are plain expressions."""
    fitting = F.array_compact(F.array(*[F.when(fits_mood(m), F.lit(m)) for m in fixed.MOOD_RULES]))
    return tracks.withColumn("mood", F.explode(fitting))


def by_every_context(tracks: DataFrame) -> DataFrame:
    fitting = F.array_compact(
        F.array(*[F.when(fits_mood(m), F.lit(c)) for c, m in fixed.CONTEXT_MOODS.items()])
    )
    return tracks.withColumn("context", F.explode(fitting))


def popular_sample(rows: DataFrame, by: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` of the 100 most popular rows per label, most popular first."""
    pool = top_per_key(rows, [by], [F.desc("popularity"), F.col("track_id")], POOL, "pool_rank")
    pick = F.md5(F.concat(F.col("track_id"), F.lit(f"-{seed}")))
    chosen = top_per_key(pool, [by], [pick, F.col("track_id")], k, "pick_rank").drop("pick_rank")
    return top_per_key(chosen, [by], [F.desc("popularity"), F.col("track_id")], k)


def mood_top(tracks: DataFrame, mood: str, k: int = 10) -> DataFrame:
    """Songs for one mood; an unknown one counts as happy."""
    mood = mood.lower() if mood.lower() in fixed.MOOD_RULES else "happy"
    return popular_sample(tracks.filter(fits_mood(mood)).withColumn("mood", F.lit(mood)), "mood", k)


def context_top(tracks: DataFrame, context: str, k: int = 10) -> DataFrame:
    return mood_top(tracks, fixed.CONTEXT_MOODS.get(context.lower(), "happy"), k)


def mood_request(tracks: DataFrame, mood: str, limit: int = 10) -> DataFrame:
    """``mood_top`` as users ask for it: an unknown mood or a limit out of range is an error."""
    return mood_top(tracks, check_mood(mood), check_limit(limit, fixed.RESULT_LIMITS))


def context_request(tracks: DataFrame, context: str, limit: int = 10) -> DataFrame:
    return context_top(tracks, check_context(context), check_limit(limit, fixed.RESULT_LIMITS))


def label_search(tracks: DataFrame, k: int = 10, seed: int = 42, encoder: Encoder | None = None) -> DataFrame:
    """Tracks nearest to each label profile by cosine of their codes.

    Profiles and tracks are encoded by the same model; without one, codes are
    the z-scored features. ``k`` of the nearest 50 per label are drawn, nearest
    first.
    """
    near = nearest(tracks, "track_id", encoder or fit_scaler(tracks), fixed.LABEL_PROFILES, LABEL_POOL)
    pick = F.md5(F.concat("query_id", F.lit("|"), "neighbour_id", F.lit(f"-{seed}")))
    drawn = top_per_key(near.drop("rank"), ["query_id"], [pick], k, "pick").drop("pick")
    ranked = top_per_key(drawn, ["query_id"], [F.desc("similarity"), F.col("neighbour_id")], k)
    return relative_scores(ranked, "similarity", "query_id", fixed.RELATIVE_RANGE)
