"""Queries over column functions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions import numeric as N
from songloom.functions import text as X
from songloom.operators import cache, moods, prepare, search
from songloom.operators import statistics as S
from songloom.plans.accounts import cache_entries
from songloom.plans.registry import query
from songloom.plans.twins import ENTRIES, LYRICS, RAW, REPLAY, TRACKS, with_
from songloom.sources import catalogue
from songloom.sources.readers import Tables

CLEAN = r"""trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(
  {x}, 'https?://\S+|www\.\S+', '', 'g'), '<[^>]+>', '', 'g'), '\[.*?\]', '', 'g')),
  '[^\p{{L}}\p{{N}}_\s''".,!?]', ' ', 'g'), '\s+', ' ', 'g'))"""
SPELLINGS = [*fixed.PITCH_CLASSES, "H"]
PITCH_SQL = "CASE " + " ".join(f"WHEN root = '{k}' THEN {v}" for k, v in fixed.PITCH_CLASSES.items()) + f" ELSE {fixed.UNKNOWN_PITCH} END"
MARKED_SQL = " OR ".join(f"contains(lower(text), '{m}')" for m in fixed.NON_ORIGINAL_MARKERS)
CODES_SQL = "CASE lower({x}) " + " ".join(f"WHEN '{e}' THEN {c}" for e, c in fixed.EMOTION_CODES.items()) + " END"
EMOTION_TEXT_SQL = "CASE genre WHEN 'ECONOMY' THEN 'thirst' WHEN 'SMALL' THEN NULL ELSE upper(emotion) END"
AS_OF_SQL = "(SELECT max(ts) FROM events)"
LABEL_WORDS = ["HAPPY", "sad", "party", "Study", "jazz", "calm"]


def emotion_text(t: Tables) -> DataFrame:
    """Tracks whose emotion label is upper case, unknown or missing."""
    raw = F.when(F.col("genre") == "ECONOMY", F.lit("thirst")).when(F.col("genre") != "SMALL", F.upper("emotion"))
    return catalogue.tracks(t).select("track_id", raw.alias("emotion"))


@query('SELECT p_partkey AS id, p_brand AS song, p_name AS song_name, p_type AS genre, p_retailprice AS popularity FROM part')
def rename_columns(t: Tables) -> DataFrame:
    """``song`` stays, because ``song_name`` is already there."""
    raw = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("song"), F.col("p_name").alias("song_name"),
        F.col("p_type").alias("Genre"), F.col("p_retailprice").alias("Popularity"),
    )
    return prepare.harmonise_names(raw)


@query("""SELECT event_id, try_cast(CASE event_type WHEN 'view' THEN event_type ELSE ' ' || json_extract_string(props, '$.k') || '.5 ' END AS DOUBLE) AS number FROM events""")
def coerce_numeric(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(
        F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit(".5 "))
    )
    return t.events.select("event_id", text.alias("number")).transform(lambda d: prepare.coerce_numbers(d, ["number"]))


@query(with_(RAW) + """
SELECT track_id, CASE WHEN (SELECT max(energy) FROM raw) > 1 THEN energy / 100.0::DOUBLE ELSE energy END AS energy,
  CASE WHEN (SELECT max(danceability) FROM raw) > 1 THEN danceability / 100.0::DOUBLE ELSE danceability END AS danceability,
  CASE WHEN (SELECT max(valence) FROM raw) > 1 THEN valence / 100.0::DOUBLE ELSE valence END AS valence
FROM raw""")
def rescale_features(t: Tables) -> DataFrame:
    features = ["energy", "danceability", "valence"]
    return S.rescale_percent(catalogue.raw_tracks(t).select("track_id", *features), features)


@query("SELECT p_partkey, try_cast('-' || p_size || '.25' AS DOUBLE) AS loudness FROM part")
def parse_loudness(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(F.lit("db"), F.lit(" dB"), F.lit(" DB"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", N.parse_loudness(F.concat(F.lit("-"), F.col("p_size"), F.lit(".25"), unit)).alias("loudness"))


@query(f"""WITH k AS (SELECT p_partkey, {SPELLINGS}[p_size % {len(SPELLINGS)} + 1] AS root FROM part)
SELECT p_partkey, ({PITCH_SQL}) / 11 AS pitch FROM k""")
def parse_key(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(s) for s in SPELLINGS])
    written = F.concat(F.element_at(names, F.col("p_size") % len(SPELLINGS) + 1), F.lit(" "), F.col("p_type"))
    return t.part.select("p_partkey", N.pitch_of_key(written).alias("pitch"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 0 ELSE p_size % 12 END AS "key",
CASE WHEN p_type = 'SMALL' THEN 0 ELSE p_size % 2 END AS "mode" FROM part""")
def wrap_key_mode(t: Tables) -> DataFrame:
    text = F.when(F.col("p_type") == "SMALL", F.lit("unknown")).otherwise(F.col("p_size").cast("string"))
    return t.part.select("p_partkey", N.wrap(text, 12).alias("key"), N.wrap(text, 2).alias("mode"))


@query(with_(TRACKS) + f"""SELECT track_id, code FROM (SELECT track_id, {CODES_SQL.format(x=EMOTION_TEXT_SQL)} AS code FROM tracks) WHERE code IS NOT NULL""")
def encode_emotion_strict(t: Tables) -> DataFrame:
    return emotion_text(t).select("track_id", N.emotion_code(F.col("emotion")).alias("code")).dropna()


@query(with_(TRACKS) + f"""SELECT track_id, coalesce({CODES_SQL.format(x="coalesce(" + EMOTION_TEXT_SQL + ", 'joy')")}, 0) AS code FROM tracks""")
def encode_emotion_lenient(t: Tables) -> DataFrame:
    return emotion_text(t).select("track_id", N.emotion_code_lenient(F.col("emotion")).alias("code"))


@query(with_(LYRICS) + "SELECT doc_id, md5(trim(lower(coalesce(artist, ''))) || '|' || trim(lower(coalesce(lyrics, '')))) AS key_md5 FROM lyrics")
def merge_key(t: Tables) -> DataFrame:
    return catalogue.lyrics(t).select("doc_id", F.md5(X.merge_key(F.col("artist"), F.col("lyrics"))).alias("key_md5"))


@query(with_(TRACKS) + "SELECT DISTINCT trim(artist) || '|' || trim(song) AS song_id FROM tracks")
def song_ids(t: Tables) -> DataFrame:
    return catalogue.tracks(t).select(X.song_id(F.col("artist"), F.col("song")).alias("song_id")).distinct()


@query(f"SELECT page_id, {CLEAN.format(x='html')} AS cleaned FROM pages")
def clean_text(t: Tables) -> DataFrame:
    return t.spread("pages", "page_id").select("page_id", X.clean_text(F.col("html")).alias("cleaned"))


@query(f"""SELECT doc_id, md5(concat_ws(' ', CASE WHEN source <> '' THEN '[EMOTION: ' || source || ']' END,
  CASE WHEN lang <> 'en' THEN '[GENRE: ' || lang || ']' END, CASE WHEN c <> '' THEN c END)) AS combined_md5
FROM (SELECT doc_id, source, lang, {CLEAN.format(x='text')} AS c FROM documents)""")
def combine_text(t: Tables) -> DataFrame:
    genre = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang"))
    combined = X.combine_text(X.clean_text(F.col("text")), F.col("source"), genre)
    return t.spread("documents", "doc_id").select("doc_id", F.md5(combined).alias("combined_md5"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN s_name || ', ' || n_name ELSE n_name END AS artist
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def clean_artist(t: Tables) -> DataFrame:
    both = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    raw = (
        F.when(F.col("s_suppkey") % 3 == 0, F.format_string("['%s']", "s_name"))
        .when(F.col("s_suppkey") % 3 == 1, F.format_string("['%s', \"%s\", '']", "s_name", "n_name"))
        .otherwise(F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")))
    )
    return both.select("s_suppkey", X.clean_artist(raw).alias("artist"))


@query(f"SELECT doc_id, ({MARKED_SQL}) AS is_remix FROM documents")
def remix_flag(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id").select("doc_id", X.is_non_original(F.col("text")).alias("is_remix"))


SEARCH_PREFIX = "https://example.org/search/"


@query(f"""SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN 'https://example.com/' || p_partkey END,
'{SEARCH_PREFIX}' || replace(trim(p_name || ' ' || CASE WHEN p_size > 10 THEN p_brand ELSE '' END), ' ', '%20')) AS url FROM part""")
def search_url(t: Tables) -> DataFrame:
    exact = F.when(F.col("p_size") > 25, F.concat(F.lit("https://example.com/"), F.col("p_partkey")))
    artist = F.when(F.col("p_size") > 10, F.col("p_brand"))
    return t.part.select("p_partkey", F.coalesce(exact, X.search_url(F.col("p_name"), artist, SEARCH_PREFIX)).alias("url"))


@query(f"""WITH e AS (SELECT event_id, (epoch_us({AS_OF_SQL}) - epoch_us(ts)) / 1000000.0::DOUBLE AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago'
 WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago' ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago' END AS label FROM e""")
def time_ago(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts")).scalar()
    return t.events.withColumn("as_of", newest).select("event_id", X.time_ago(F.col("ts"), F.col("as_of")).alias("label"))


@query("""WITH d AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value * 10000) AS BIGINT) END AS ms FROM events),
m AS (SELECT event_id, ms, ms // 60000 AS mi, CAST(floor((ms % 60000) / 1000 + 0.5) AS BIGINT) AS se FROM d)
SELECT event_id, CASE WHEN ms = 0 THEN '' ELSE mi || ':' || lpad(se::VARCHAR, 2, '0') END AS duration FROM m""")
def format_duration(t: Tables) -> DataFrame:
    ms = F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.floor(F.col("value") * 10000))
    return t.events.select("event_id", X.format_duration(ms).alias("duration"))


TRACK_JSON = (
    "name string, artists array<struct<name:string>>, album struct<name:string, images:array<struct<url:string>>>, "
    "popularity int, duration_ms bigint, explicit boolean"
)


@query("""SELECT event_id, event_type AS name, CASE WHEN event_type = 'error' THEN 'Unknown' ELSE 'user ' || user_id END AS artist,
 CASE WHEN event_type = 'error' THEN '' ELSE 'user ' || user_id || ',guest' END AS artists,
 'album' AS album, CASE WHEN event_type <> 'view' THEN 'u/' || event_id END AS album_art,
 CASE WHEN event_type = 'click' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS popularity,
 0 AS duration_ms, false AS explicit FROM events""")
def flatten_json(t: Tables) -> DataFrame:
    """Nested track documents, built from the events, to flat rows."""
    kind = F.col("event_type")
    document = F.to_json(
        F.struct(
            kind.alias("name"),
            F.when(kind == "error", F.array().cast("array<struct<name:string>>"))
            .otherwise(F.array(F.struct(F.concat(F.lit("user "), F.col("user_id")).alias("name")), F.struct(F.lit("guest").alias("name"))))
            .alias("artists"),
            F.struct(
                F.lit("album").alias("name"),
                F.when(kind != "view", F.array(F.struct(F.concat(F.lit("u/"), F.col("event_id")).alias("url")))).alias("images"),
            ).alias("album"),
            F.when(kind != "click", F.get_json_object("props", "$.k").cast("int")).alias("popularity"),
        )
    )
    row = t.spread("events", "event_id").select("event_id", F.from_json(document, TRACK_JSON).alias("d"))
    names = F.transform("d.artists", lambda a: a.getField("name"))
    return row.select(
        "event_id", "d.name", F.coalesce(F.try_element_at(names, F.lit(1)), F.lit("Unknown")).alias("artist"),
        F.array_join(names, ",").alias("artists"), F.col("d.album.name").alias("album"),
        F.try_element_at("d.album.images", F.lit(1)).getField("url").alias("album_art"),
        F.coalesce("d.popularity", F.lit(0)).alias("popularity"), F.coalesce("d.duration_ms", F.lit(0)).cast("int").alias("duration_ms"),
        F.coalesce("d.explicit", F.lit(False)).alias("explicit"),
    )


@query(f"""WITH w AS (SELECT event_id, {LABEL_WORDS}[event_id % 6 + 1] AS label FROM events)
SELECT event_id, CASE WHEN lower(label) IN ('happy','sad','energetic','calm','angry') THEN lower(label) ELSE 'happy' END AS mood,
 CASE lower(label) WHEN 'party' THEN 'energetic' WHEN 'workout' THEN 'energetic' WHEN 'study' THEN 'calm' WHEN 'relax' THEN 'calm' ELSE 'happy' END AS context_mood,
 CASE WHEN lower(label) IN ('happy','sad','energetic','calm','angry','party','workout','study','relax','driving')
   THEN upper(label[1]) || lower(label[2:]) ELSE 'Calm' END AS profile FROM w""")
def resolve_label(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in LABEL_WORDS])
    label = F.element_at(words, (F.col("event_id") % 6 + 1).cast("int"))
    return t.events.select(
        "event_id", moods.resolve_mood(label).alias("mood"), moods.resolve_context(label).alias("context_mood"),
        moods.resolve_profile(label).alias("profile"),
    )


@query(with_(TRACKS) + "SELECT track_id, length_ms / 60000 AS minutes, year(release_date) AS year, year(release_date) // 10 * 10 AS decade FROM tracks")
def unit_and_date_parts(t: Tables) -> DataFrame:
    year = N.year_of(F.col("release_date").cast("string"))
    return catalogue.tracks(t).select(
        "track_id", N.minutes(F.col("length_ms")).alias("minutes"), year.cast("bigint").alias("year"), N.decade_of(year).cast("bigint").alias("decade")
    )


# --- filters ------------------------------------------------------------------


@query(with_(RAW) + "SELECT track_id, danceability, valence FROM raw WHERE danceability IS NOT NULL AND valence IS NOT NULL")
def dropna_features(t: Tables) -> DataFrame:
    return S.drop_incomplete(catalogue.raw_tracks(t).select("track_id", "danceability", "valence"), ["danceability", "valence"])


@query("SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL AND length(text) > 50")
def valid_text(t: Tables) -> DataFrame:
    return prepare.valid_text(t.documents, "text").select("doc_id", "n_chars")


MOOD_SQL = {
    "happy": "emotion = 'joy' AND valence BETWEEN 0.6::DOUBLE AND 1 AND energy BETWEEN 0.5::DOUBLE AND 1",
    "sad": "emotion = 'sadness' AND valence BETWEEN 0 AND 0.4::DOUBLE AND energy BETWEEN 0 AND 0.5::DOUBLE",
    "energetic": "emotion = 'joy' AND valence BETWEEN 0.5::DOUBLE AND 1 AND energy BETWEEN 0.7::DOUBLE AND 1",
    "calm": "valence BETWEEN 0.4::DOUBLE AND 0.7::DOUBLE AND energy BETWEEN 0 AND 0.4::DOUBLE",
    "angry": "emotion = 'anger' AND valence BETWEEN 0 AND 0.4::DOUBLE AND energy BETWEEN 0.7::DOUBLE AND 1",
}


@query(with_(TRACKS) + "\nUNION ALL\n".join(f"SELECT '{m}' AS mood, track_id FROM tracks WHERE {rule}" for m, rule in MOOD_SQL.items()))
def mood_filter(t: Tables) -> DataFrame:
    return moods.by_every_mood(catalogue.tracks(t)).select("mood", "track_id")


@query(with_(TRACKS) + "\nUNION ALL\n".join(f"SELECT '{c}' AS context, track_id FROM tracks WHERE {MOOD_SQL[m]}" for c, m in fixed.CONTEXT_MOODS.items()))
def context_filter(t: Tables) -> DataFrame:
    return moods.by_every_context(catalogue.tracks(t)).select("context", "track_id")


@query(with_(TRACKS) + "SELECT emotion, allowed, count(*) AS queries FROM tracks JOIN (VALUES "
       + ", ".join(f"('{a}', '{b}')" for a, b in search.emotion_pairs()) + ") p(e, allowed) ON emotion = e GROUP BY 1, 2")
def compatible_emotions(t: Tables) -> DataFrame:
    rows = catalogue.tracks(t).groupBy("emotion").agg(F.count("*").alias("queries"))
    return rows.select("emotion", F.explode(search.lookup_list(F.col("emotion"))).alias("allowed"), "queries")


@query(with_(TRACKS) + """SELECT track_id, genre FROM tracks WHERE genre IN (SELECT genre FROM tracks GROUP BY genre HAVING count(*) >= 500)""")
def frequent_groups(t: Tables) -> DataFrame:
    tracks = catalogue.tracks(t).select("track_id", "genre")
    frequent = tracks.groupBy("genre").count().filter(F.col("count") >= 500)
    return tracks.join(frequent, "genre", "left_semi").select("track_id", "genre")


@query(REPLAY + f", {ENTRIES} SELECT key, id FROM entries WHERE expires > epoch_us({AS_OF_SQL})")
def live_entries(t: Tables) -> DataFrame:
    as_of = t.events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).scalar()
    return cache.live(cache_entries(t).withColumn("as_of", as_of), F.col("as_of")).select("key", "id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 50")
def json_flag_filter(t: Tables) -> DataFrame:
    """Persisted are only answers whose payload says found."""
    payload = F.from_json("props", "k int")
    return t.events.select("event_id", payload.alias("data")).filter(F.col("data.k") >= 50).select("event_id", "data.k")
