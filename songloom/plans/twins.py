"""SQL fragments shared by the twins."""

from songloom import fixed

EMOTION = "['joy','sadness','anger','fear','love','surprise']"

TRACKS = f"""tracks AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS track_id,
    p_name AS song, s_name AS artist, p_type AS genre, p_brand AS album,
    {EMOTION}[l_linenumber % 6 + 1] AS emotion, p_retailprice AS popularity,
    l_quantity / 50 AS energy, l_tax * 12.5::DOUBLE AS danceability, l_discount * 10 AS valence,
    l_extendedprice AS tempo, p_size / 50 AS acousticness, s_nationkey / 24 AS instrumentalness,
    l_linenumber / 7 AS speechiness, abs(s_acctbal) / 10000 AS liveness,
    (l_suppkey % 12) / 11 AS "key", l_shipdate AS release_date, l_extendedprice * 3 AS length_ms
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

RAW = """raw AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS track_id, p_name AS song,
    l_quantity AS energy, nullif(l_tax, 0) AS danceability, nullif(l_discount, 0) AS valence,
    l_extendedprice AS tempo
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

SONGS = f"""songs AS (
  SELECT p_partkey AS pos, p_name AS song, p_brand AS artist, p_type AS genre,
    {EMOTION}[p_size % 6 + 1] AS emotion, p_retailprice AS popularity FROM part)"""

LYRICS = """lyrics AS (
  SELECT doc_id, source AS artist, lang AS genre, text AS lyrics, n_chars, quality, toxic
  FROM documents LEFT JOIN labels USING (doc_id))"""

VECTORS = f"""vectors AS (
  SELECT vec_id AS id, p_name AS song, p_brand AS artist, p_type AS genre,
    {EMOTION}[label % 6 + 1] AS emotion, embedding::DOUBLE[] AS embedding
  FROM embeddings JOIN part ON vec_id = p_partkey)"""

HISTORY = """history AS (
  SELECT event_id AS id, user_id, 'song ' || json_extract_string(props, '$.k') AS query_song,
    event_type AS query_artist, CAST(floor(value) AS BIGINT) AS results_count, ts AS searched_at
  FROM events)"""

LOOKUPS = """lookups AS (
  SELECT event_id AS id, ts, user_id || '|' || event_type AS key,
    CASE event_type WHEN 'error' THEN 30 WHEN 'view' THEN 300 ELSE 86400 END AS ttl
  FROM events)"""

REPLAY = f"""WITH RECURSIVE {LOOKUPS},
o AS (SELECT key, id, epoch_us(ts) AS at_us, ttl * 1000000::BIGINT AS ttl, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS n FROM lookups),
walk AS (
  SELECT key, id, n, at_us + ttl AS expires, false AS is_hit FROM o WHERE n = 1
  UNION ALL
  SELECT o.key, o.id, o.n, CASE WHEN walk.expires > o.at_us THEN walk.expires ELSE o.at_us + o.ttl END, walk.expires > o.at_us
  FROM walk JOIN o ON o.key = walk.key AND o.n = walk.n + 1)
"""

# a hit writes nothing: a key's entry is its last miss
ENTRIES = "entries AS (SELECT key, arg_max(id, n) AS id, arg_max(expires, n) AS expires FROM walk WHERE NOT is_hit GROUP BY key)"

FEATURES = fixed.FEATURES


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def per_feature(template: str, columns: list[str] = FEATURES, glue: str = "\nUNION ALL\n") -> str:
    """The template once per column, {c} the quoted and {n} the plain name."""
    return glue.join(template.format(c=f'"{c}"', n=c) for c in columns)
