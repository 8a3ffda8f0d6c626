"""Song lookup, ranked search, autocomplete and similar songs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions.numeric import distance_score, relative_score
from songloom.functions.text import clean_artist, is_non_original
from songloom.operators.neighbours import knn
from songloom.operators.ranking import first_per_key
from songloom.session import cut_lineage


def check_limit(value: int, bounds: tuple[int, int]) -> int:
    if not bounds[0] <= value <= bounds[1]:
        raise ValueError(f"limit {value} is outside {bounds}")
    return value


def artist_matches(artist: Column, wanted: Column) -> Column:
    """No wanted artist, or its lower-case text occurs in the name."""
    return wanted.isNull() | F.contains(F.lower(artist), F.lower(wanted))


def _grams(text: Column, size: int) -> Column:
    """All substrings of one size; none for shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def find_songs(requests: DataFrame, songs: DataFrame, strict: bool = False) -> DataFrame:
    """The song meant by each request (request_id, name, artist).

    First an exact name whose artist fits, else the first name that contains
    the request; in the strict form the artist must fit there as well. Names
    are folded before matching. The contains step joins on the rarest trigram
    of the request, so only names sharing it are compared.
    """
    asked = requests.select("request_id", F.lower("name").alias("name"), "artist").filter(F.trim("name") != "")
    names = songs.groupBy(F.lower("song").alias("lname"), F.lower("artist").alias("lartist")).agg(F.min("pos").alias("pos"))
    fits = artist_matches(F.col("lartist"), F.col("artist"))
    exact = (
        asked.join(names, asked["name"] == names["lname"])
        .filter(fits)
        .groupBy("request_id")
        .agg(F.min("pos").alias("exact_pos"))
    )
    grams = names.select(
        "lname", "lartist", "pos",
        F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*[_grams(F.col("lname"), s) for s in (1, 2, 3)]))))).alias("gram"),
    )
    counts = grams.groupBy("gram").agg(F.count("*").alias("names"))
    size = F.least(F.lit(3), F.length("name"))
    own = F.transform(
        F.sequence(F.lit(1), F.length("name") - size + 1), lambda i: F.substring(F.col("name"), i, size)
    )
    rarest = (
        asked.withColumn("gram", F.explode(F.array_distinct(own)))
        .join(counts, "gram", "left")
        .groupBy("request_id", "name", "artist")
        .agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), F.col("gram"))).alias("gram"))
    )
    within = F.contains(F.col("lname"), F.col("name"))
    if strict:
        within = within & fits
    partial = rarest.join(grams, "gram").filter(within).groupBy("request_id").agg(F.min("pos").alias("part_pos"))
    chosen = (
        exact.join(partial, "request_id", "full")
        .select("request_id", F.coalesce("exact_pos", "part_pos").alias("pos"), F.col("exact_pos").isNotNull().alias("is_exact"))
    )
    return chosen.join(songs, "pos")


def song_search(songs: DataFrame, query: str, artist: str | None = None) -> DataFrame:
    """Songs whose name contains the query, one per (song, artist).

    Originals come first, then the other versions, each by name.
    """
    q = query.lower().strip()
    name = F.lower("song")
    hits = songs.filter(name.contains(q) if q else F.lit(False)).select(
        "pos",
        F.trim("song").alias("song"),
        clean_artist(F.col("artist")).alias("artist"),
        "genre",
        "emotion",
        F.when(name.startswith(q), 0).otherwise(1).alias("match_class"),
    )
    keyed = hits.withColumns({"_song": F.lower("song"), "_artist": F.lower("artist")})
    unique = first_per_key(keyed, ["_song", "_artist"], ["match_class", "pos"])
    if artist:
        unique = unique.filter(F.col("_artist").contains(artist.strip().lower()))
    return (
        unique.withColumn("is_remix", is_non_original(F.col("song")))
        .orderBy("is_remix", "_song", "match_class", "pos")
        .drop("_song", "_artist")
    )


def search_counts(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_remix")).alias("originals_count"),
        F.count_if("is_remix").alias("remixes_count"),
    )


def autocomplete(songs: DataFrame, prefix: str, k: int = 8, pool: int | None = 30) -> DataFrame:
    """First ``k`` distinct songs by prefix, from the first ``pool`` matches."""
    q = prefix.lower().strip()
    hits = songs.filter(F.lower("song").startswith(q) if q else F.lit(False)).select("pos", "song", "artist")
    if pool is None:
        hits = hits.select("pos", F.trim("song").alias("song"), clean_artist(F.col("artist")).alias("artist"))
    else:
        hits = hits.orderBy("pos").limit(pool)
    keyed = hits.withColumns({"_song": F.lower("song"), "_artist": F.lower("artist")})
    return first_per_key(keyed, ["_song", "_artist"], ["pos"]).orderBy("pos").limit(k).select("pos", "song", "artist")


def similar_songs(query_ids: DataFrame, catalogue: DataFrame, k: int = 5) -> DataFrame:
    """Similar songs for each query id, filtered by title and emotion.

    Of the nearest 3k+1, those with another title and a compatible emotion are
    kept, at most k. If none is left, the nearest k+1 with another title are
    shown. Score: 1 / (1 + squared distance).
    """
    queries = catalogue.join(query_ids, "id", "left_semi")
    found = knn(queries.select("id", "embedding"), catalogue.select("id", "embedding"), 3 * k + 1)
    asked = queries.select(F.col("id").alias("query_id"), F.lower("song").alias("query_song"), F.lower("emotion").alias("query_emotion"))
    shown = catalogue.select(F.col("id").alias("neighbour_id"), "song", "artist", "genre", "emotion")
    rows = found.join(asked, "query_id").join(shown, "neighbour_id")
    mood = F.col("query_emotion")
    allowed = F.coalesce(lookup_list(mood), F.when(mood != "", F.array(mood)))
    other_title = F.lower("song") != F.col("query_song")
    suits = allowed.isNull() | (F.col("emotion") == "") | F.array_contains(allowed, F.lower("emotion"))
    # a query has at most 3k+1 rows here
    per_query = Window.partitionBy("query_id")
    in_order = per_query.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("ok", other_title & suits)
        .withColumn("n_ok", F.count_if("ok").over(per_query))
        .withColumn("ok_rank", F.count_if("ok").over(in_order))
        .filter(
            ((F.col("n_ok") > 0) & F.col("ok") & (F.col("ok_rank") <= k))
            | ((F.col("n_ok") == 0) & (F.col("rank") <= k + 1) & other_title)
        )
        .select("query_id", "neighbour_id", "song", "artist", "genre", "emotion", distance_score(F.col("distance")).alias("similarity"))
    )


def similar_songs_by_name(requests: DataFrame, songs: DataFrame, catalogue: DataFrame, k: int = 5) -> DataFrame:
    """``similar_songs`` of the song that each request (request_id, name, artist) means.

    Requests for the same song share one search. A request that finds no song, or one that the catalogue lacks, has
    no rows; ``learning.encode_missing`` gives a catalogue without such gaps.
    """
    return _by_name(find_songs(requests, songs), lambda ids: similar_songs(ids, catalogue, k))


def similar_tracks_by_name(requests: DataFrame, songs: DataFrame, catalogue: DataFrame, k: int = 10) -> DataFrame:
    """``similar_tracks`` by name; here the artist must fit, also where only a part of the name matches."""
    return _by_name(find_songs(requests, songs, strict=True), lambda ids: similar_tracks(ids, catalogue, k))


def _by_name(found: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    meant = cut_lineage(found.select("request_id", F.col("pos").alias("query_id")), "meant")
    return meant.join(search(meant.select(F.col("query_id").alias("id")).distinct()), "query_id")


def lookup_list(emotion: Column) -> Column:
    """Emotions compatible with a known one, else null."""
    pairs = [x for e, fit in fixed.COMPATIBLE_EMOTIONS.items() for x in (F.lit(e), F.array(*[F.lit(f) for f in fit]))]
    return F.try_element_at(F.create_map(*pairs), emotion)


def relative_scores(rows: DataFrame, value: str, by: str, span: tuple[float, float], inverted: bool = False) -> DataFrame:
    """Scores moved into a display range per query; inverted for distances.

    Result sets are already cut to k rows per query, so the window is small.
    """
    per = Window.partitionBy(by)
    x = -F.col(value) if inverted else F.col(value)
    lo, hi = (F.min(x).over(per), F.max(x).over(per))
    return rows.withColumn("score", relative_score(x, lo, hi, *span))


def similar_tracks(query_ids: DataFrame, catalogue: DataFrame, k: int = 10) -> DataFrame:
    """Nearest tracks by cosine without the query itself, relative scores."""
    queries = catalogue.join(query_ids, "id", "left_semi")
    found = knn(queries.select("id", "embedding"), catalogue.select("id", "embedding"), k + 1, metric="cosine")
    others = found.filter(F.col("query_id") != F.col("neighbour_id")).filter(
        F.col("rank") <= k + 1
    )
    in_order = Window.partitionBy("query_id").orderBy("rank")
    cut = others.withColumn("rank", F.row_number().over(in_order).cast("bigint")).filter(F.col("rank") <= k)
    shown = catalogue.select(F.col("id").alias("neighbour_id"), "song", "artist", "genre", "emotion")
    return relative_scores(cut, "similarity", "query_id", fixed.RELATIVE_RANGE).join(shown, "neighbour_id")


def attribute_search(
    tracks: DataFrame, targets: dict[str, float], minimum: dict[str, float], maximum: dict[str, float],
    seed_genres: list[str], k: int,
) -> DataFrame:
    """Tracks inside the attribute bands, nearest to the targets first."""
    if len(seed_genres) > 5:
        raise ValueError("at most five seeds")
    keep = F.col("genre").isin(seed_genres) if seed_genres else F.lit(True)
    for name, value in minimum.items():
        keep = keep & (F.col(name) >= value)
    for name, value in maximum.items():
        keep = keep & (F.col(name) <= value)
    gap = F.lit(0.0)
    for name, value in targets.items():
        gap = gap + F.abs(F.col(name) - value)
    return tracks.filter(keep).withColumn("gap", gap).orderBy("gap", "track_id").limit(k)


def emotion_pairs() -> list[tuple[str, str]]:
    return [(e, f) for e, fit in fixed.COMPATIBLE_EMOTIONS.items() for f in fit]
