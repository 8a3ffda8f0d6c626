"""Lookup, search, mood and context queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions.text import clean_artist
from songloom.operators import moods, search
from songloom.operators.names import NameIndex
from songloom.plans.registry import query
from songloom.plans.scalars import MOOD_SQL
from songloom.plans.twins import SONGS, TRACKS, with_
from songloom.session import scratch_path
from songloom.sources import catalogue
from songloom.sources.readers import Tables

REQUESTS = """requests AS (
  SELECT 'name:' || p_name AS request_id, p_name AS name, min(p_brand) AS artist FROM part GROUP BY p_name
  UNION SELECT 'last:' || split_part(p_name, ' ', 2), upper(split_part(p_name, ' ', 2)), NULL FROM part
  UNION SELECT 'first:' || split_part(p_name, ' ', 1), split_part(p_name, ' ', 1), 'BRAND#1' FROM part
  UNION SELECT 'brand:' || p_name || p_brand, p_name, p_brand FROM part)"""


def requests(t: Tables) -> DataFrame:
    """Lookups by full name, by one word, and by name and artist."""
    words = F.split("p_name", " ")
    first, last = F.element_at(words, 1), F.element_at(words, 2)
    forms = [
        t.part.groupBy("p_name").agg(F.min("p_brand").alias("artist")).select(F.concat(F.lit("name:"), "p_name").alias("request_id"), F.col("p_name").alias("name"), "artist"),
        t.part.select(F.concat(F.lit("last:"), last).alias("request_id"), F.upper(last).alias("name"), F.lit(None).cast("string").alias("artist")),
        t.part.select(F.concat(F.lit("first:"), first).alias("request_id"), first.alias("name"), F.lit("BRAND#1").alias("artist")),
        t.part.select(F.concat(F.lit("brand:"), "p_name", "p_brand").alias("request_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("artist")),
    ]
    out = forms[0]
    for form in forms[1:]:
        out = out.unionByName(form)
    return out.distinct()


def find_sql(strict: bool) -> str:
    fits = "(r.artist IS NULL OR contains(lower(s.artist), lower(r.artist)))"
    also = f" AND {fits}" if strict else ""
    return with_(SONGS, REQUESTS) + f""", m AS (
  SELECT request_id, pos, lower(song) = lower(name) AS is_exact,
    row_number() OVER (PARTITION BY request_id ORDER BY (lower(song) = lower(name) AND {fits}) DESC, pos) AS rk,
    (lower(song) = lower(name) AND {fits}) AS hit
  FROM requests r JOIN songs s ON contains(lower(song), lower(name))
  WHERE (lower(song) = lower(name) AND {fits}) OR (contains(lower(song), lower(name)){also}))
SELECT request_id, pos, hit AS is_exact, song, artist FROM m JOIN songs USING (pos) WHERE rk = 1"""


@query(find_sql(strict=False))
def find_song(t: Tables) -> DataFrame:
    found = search.find_songs(requests(t), catalogue.songs(t))
    return found.select("request_id", "pos", "is_exact", "song", "artist")


@query(find_sql(strict=True))
def find_track(t: Tables) -> DataFrame:
    found = search.find_songs(requests(t), catalogue.songs(t), strict=True)
    return found.select("request_id", "pos", "is_exact", "song", "artist")


def stored_names(t: Tables) -> NameIndex:
    """An index built of two thirds of the songs, the others appended, and opened again."""
    folder = scratch_path(t.spark, "name-index")
    songs = catalogue.songs(t)
    NameIndex.build(songs.filter("pos % 3 <> 1"), folder).append(songs.filter("pos % 3 = 1"))
    return NameIndex(t.spark, folder)


@query(find_sql(strict=False))
def find_song_stored(t: Tables) -> DataFrame:
    """The lookup by stored lists: what ``find_song`` finds."""
    return stored_names(t).find(requests(t)).join(catalogue.songs(t), "pos").select("request_id", "pos", "is_exact", "song", "artist")


@query(find_sql(strict=True))
def find_track_stored(t: Tables) -> DataFrame:
    """The strict lookup by stored lists: what ``find_track`` finds."""
    return stored_names(t).find(requests(t), strict=True).join(catalogue.songs(t), "pos").select("request_id", "pos", "is_exact", "song", "artist")


TITLES = """titles AS (SELECT l_orderkey * 8 + l_linenumber AS line, p_partkey AS pos,
  CASE l_linenumber % 4 WHEN 0 THEN p_name || ' (Live)' WHEN 1 THEN p_name || ' Remix' ELSE p_name END AS song,
  '[''' || p_brand || ''']' AS artist, p_type AS genre FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SEARCH_SQL = with_(TITLES) + """, h AS (SELECT *, replace(replace(artist, '[''', ''), ''']', '') AS a FROM titles WHERE contains(lower(song), 'ring')),
f AS (SELECT trim(song) AS song, a AS artist, min(pos) AS pos FROM h GROUP BY lower(trim(song)), lower(a), 1, 2),
r AS (SELECT *, contains(lower(song), 'remix') OR contains(lower(song), 'live') AS is_remix FROM f)
"""


def titles(t: Tables) -> DataFrame:
    """Track titles with live and remix versions, artists in list form."""
    version = (F.col("l_linenumber") % 4)
    title = (
        F.when(version == 0, F.concat("p_name", F.lit(" (Live)")))
        .when(version == 1, F.concat("p_name", F.lit(" Remix")))
        .otherwise(F.col("p_name"))
    )
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("pos"), title.alias("song"), F.format_string("['%s']", "p_brand").alias("artist"),
        F.col("p_type").alias("genre"), catalogue.emotion_by_number(F.col("p_size")).alias("emotion"),
    )


@query(SEARCH_SQL + "SELECT pos, song, artist, is_remix FROM r")
def song_search(t: Tables) -> DataFrame:
    return search.song_search(titles(t), "Ring ").select("pos", "song", "artist", "is_remix")


@query(SEARCH_SQL + "SELECT pos, song, artist, is_remix FROM r WHERE contains(lower(artist), 'brand#1')")
def song_search_artist(t: Tables) -> DataFrame:
    return search.song_search(titles(t), "ring", " Brand#1 ").select("pos", "song", "artist", "is_remix")


@query(SEARCH_SQL + "SELECT count(*) AS total, count(*) FILTER (NOT is_remix) AS originals_count, count(*) FILTER (is_remix) AS remixes_count FROM r")
def search_counts(t: Tables) -> DataFrame:
    return search.search_counts(search.song_search(titles(t), "ring"))


@query(with_(SONGS) + """, m AS (SELECT pos, song, artist FROM songs WHERE starts_with(lower(song), 'sm') ORDER BY pos LIMIT 30)
SELECT min(pos) AS pos, song, artist FROM m GROUP BY song, artist ORDER BY 1 LIMIT 8""")
def autocomplete(t: Tables) -> DataFrame:
    return search.autocomplete(catalogue.songs(t), " Sm")


@query(with_(SONGS) + """SELECT min(pos) AS pos, song, artist FROM songs WHERE starts_with(lower(song), 'sm') GROUP BY song, artist ORDER BY 1 LIMIT 8""")
def autocomplete_full(t: Tables) -> DataFrame:
    return search.autocomplete(catalogue.songs(t), "sm", pool=None)


def pool_sql(rows: str, by: str) -> str:
    return f""", m AS ({rows}),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY popularity DESC, track_id) AS pool_rank FROM m) WHERE pool_rank <= 100),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(track_id || '-42'), track_id) AS pick FROM p) WHERE pick <= 10)
SELECT {by}, track_id, song, artist, genre, emotion, row_number() OVER (PARTITION BY {by} ORDER BY popularity DESC, track_id) AS rank FROM c"""


SHOWN = ["track_id", "song", "artist", "genre", "emotion", "rank"]


@query(with_(TRACKS) + pool_sql(" UNION ALL ".join(f"SELECT '{m}' AS mood, * FROM tracks WHERE {rule}" for m, rule in MOOD_SQL.items()), "mood"))
def mood_topk(t: Tables) -> DataFrame:
    """Top songs of all moods in one pass."""
    return moods.popular_sample(moods.by_every_mood(catalogue.tracks(t)), "mood", 10).select("mood", *SHOWN)


@query(with_(TRACKS) + pool_sql(" UNION ALL ".join(f"SELECT '{c}' AS context, * FROM tracks WHERE {MOOD_SQL[m]}" for c, m in fixed.CONTEXT_MOODS.items()), "context"))
def context_topk(t: Tables) -> DataFrame:
    return moods.popular_sample(moods.by_every_context(catalogue.tracks(t)), "context", 10).select("context", *SHOWN)


@query(with_(TRACKS) + pool_sql(f"SELECT 'energetic' AS mood, * FROM tracks WHERE {MOOD_SQL['energetic']}", "mood"))
def by_mood(t: Tables) -> DataFrame:
    return moods.mood_top(catalogue.tracks(t), "Energetic").select("mood", *SHOWN)


@query(with_(TRACKS) + "SELECT * FROM (" + with_("dummy AS (SELECT 1)") + pool_sql(f"SELECT 'calm' AS mood, * FROM tracks WHERE {MOOD_SQL['calm']}", "mood")
       + ") UNION ALL SELECT * FROM (" + with_("dummy AS (SELECT 1)") + pool_sql(f"SELECT '{fixed.CONTEXT_MOODS['driving']}' AS mood, * FROM tracks WHERE {MOOD_SQL[fixed.CONTEXT_MOODS['driving']]}", "mood") + ")")
def checked_requests(t: Tables) -> DataFrame:
    """A mood and a context as users ask for them, after the checks of name and limit."""
    tracks = catalogue.tracks(t)
    found = moods.mood_request(tracks, "Calm", 10).unionByName(moods.context_request(tracks, "driving", 10))
    return found.select("mood", *SHOWN)


@query(with_(TRACKS) + """SELECT track_id, round(abs(energy - 0.8::DOUBLE) + abs(valence - 0.6::DOUBLE), 9) AS gap FROM tracks
WHERE genre IN ('ECONOMY', 'SMALL') AND danceability >= 0.25 AND tempo <= 60000
ORDER BY abs(energy - 0.8::DOUBLE) + abs(valence - 0.6::DOUBLE), track_id LIMIT 20""")
def attribute_band_search(t: Tables) -> DataFrame:
    found = search.attribute_search(
        catalogue.tracks(t), {"energy": 0.8, "valence": 0.6}, {"danceability": 0.25}, {"tempo": 60000.0}, ["ECONOMY", "SMALL"], 20
    )
    return found.select("track_id", F.round("gap", 9).alias("gap"))


@query(with_(TITLES) + "SELECT DISTINCT replace(replace(artist, '[''', ''), ''']', '') AS artist FROM titles")
def distinct_artists(t: Tables) -> DataFrame:
    return titles(t).select(clean_artist(F.col("artist")).alias("artist")).distinct()
