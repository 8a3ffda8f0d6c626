"""Queries over user tables and the lookup cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.operators import cache, users
from songloom.operators.ranking import global_rank
from songloom.plans.registry import query
from songloom.plans.twins import ENTRIES, HISTORY, REPLAY, with_
from songloom.sources.readers import Tables

DAY = "strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def stamp(col: str):
    """Timestamp as text with microseconds."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def history(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("id"), "user_id", F.concat(F.lit("song "), F.get_json_object("props", "$.k")).alias("query_song"),
        F.col("event_type").alias("query_artist"), F.floor("value").alias("results_count"), F.col("ts").alias("searched_at"),
    )


def lookups(t: Tables) -> DataFrame:
    """Cache lookups: one per event, the outcome given by the event type."""
    outcome = F.when(F.col("event_type") == "error", F.lit("error")).when(F.col("event_type") == "view", F.lit("missing")).otherwise(F.lit("found"))
    return t.events.select(
        F.concat_ws("|", "user_id", "event_type").alias("key"), F.col("event_id").alias("id"), "ts", cache.lifetime(outcome).alias("ttl")
    )


def cache_entries(t: Tables) -> DataFrame:
    """The last written entry of each key, its last miss, with its expiry in microseconds. A hit writes nothing."""
    asked = lookups(t)
    misses = cache.replay(asked).filter(~F.col("is_hit")).select("key", "id")
    last = asked.join(misses, ["key", "id"]).groupBy("key").agg(F.max_by(F.struct("id", "ts", "ttl"), F.struct("ts", "id")).alias("e"))
    expires = F.unix_micros(F.col("e.ts").cast("timestamp")) + F.col("e.ttl") * F.lit(cache.MICROS).cast("bigint")
    return last.select("key", "e.id", expires.alias("expires_at"))


def playlists(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("playlist_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("name"),
        F.col("o_orderdate").alias("updated_at"),
    )


def playlist_tracks(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("playlist_id"), F.col("l_partkey").alias("song_id"), F.col("l_suppkey").alias("artist_id"),
        F.col("l_linenumber").alias("position"), F.col("l_shipdate").alias("added_at"),
    )


@query(with_(HISTORY) + f"""SELECT user_id, id, {DAY.format(x='searched_at')} AS searched_at, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY searched_at DESC, id DESC) AS rank FROM history) WHERE rank <= 50""")
def history_latest(t: Tables) -> DataFrame:
    return users.latest(history(t)).select("user_id", "id", stamp("searched_at").alias("searched_at"), "rank")


@query(with_(HISTORY) + """, d AS (SELECT user_id, lower(query_song) AS song, lower(query_artist) AS artist, max(searched_at) AS newest, arg_max(id, (searched_at, id)) AS last_id FROM history GROUP BY 1, 2, 3)
SELECT user_id, song, artist, last_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY newest DESC, last_id DESC) AS rank FROM d) WHERE rank <= 10""")
def recent_distinct(t: Tables) -> DataFrame:
    return users.recent_distinct(history(t))


@query(with_(HISTORY) + """, r AS (SELECT *, row_number() OVER (ORDER BY lower(query_song), id) AS rk, count(*) OVER () AS n FROM history)
SELECT id, rk AS rank, CAST(ceil(rk / 12) AS BIGINT) AS page, CAST(ceil(n / 12) AS BIGINT) AS pages FROM r""")
def paginate(t: Tables) -> DataFrame:
    rows = history(t).select("id", F.lower("query_song").alias("song"))
    total = rows.agg(F.ceil(F.count("*") / 12)).scalar()
    ranked = global_rank(rows, ["song", "id"])
    return ranked.select("id", "rank", F.ceil(F.col("rank") / 12).alias("page"), total.alias("pages"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def history_valid_users(t: Tables) -> DataFrame:
    found = users.known_users(history(t), t.customer.filter("c_acctbal > 0"), "c_custkey")
    return found.select(F.col("id").alias("event_id"), "user_id")


@query("""SELECT event_id, user_id FROM events WHERE NOT (event_type = 'error')
 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def history_after_delete(t: Tables) -> DataFrame:
    """Single rows deleted by id and user, then whole users cleared."""
    rows = history(t)
    single = t.events.filter("event_type = 'error'").select(F.col("event_id").alias("id"), "user_id")
    cleared = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    left = users.without(users.without(rows, single, ["id", "user_id"]), cleared, ["user_id"])
    return left.select(F.col("id").alias("event_id"), "user_id")


@query("""SELECT c_custkey AS user_id, o_orderkey AS playlist_id, l_linenumber AS position, l_partkey AS song_id, l_suppkey AS artist_id
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey""")
def playlist_detail(t: Tables) -> DataFrame:
    known = t.customer.select(F.col("c_custkey").alias("user_id"))
    rows = playlists(t).join(known, "user_id").join(playlist_tracks(t), "playlist_id")
    return rows.select("user_id", "playlist_id", "position", "song_id", "artist_id").orderBy("user_id", "playlist_id", "position", "song_id", "artist_id")


@query("""SELECT o_orderkey AS playlist_id, o_custkey AS user_id, count(l_orderkey) AS track_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def playlist_track_count(t: Tables) -> DataFrame:
    counted = users.track_counts(playlists(t), playlist_tracks(t), "playlist_id")
    return counted.orderBy(F.desc("updated_at"), "playlist_id").select("playlist_id", "user_id", "track_count")


@query("SELECT o_orderkey AS playlist_id, CAST(coalesce(max(l_linenumber), -1) + 1 AS BIGINT) AS next_position FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def next_position(t: Tables) -> DataFrame:
    return users.last_positions(playlists(t).select("playlist_id"), playlist_tracks(t), "playlist_id")


@query("""WITH a AS (SELECT event_id, user_id AS playlist_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events),
l AS (SELECT l_orderkey AS playlist_id, max(l_linenumber) AS last FROM lineitem GROUP BY 1)
SELECT event_id, playlist_id, coalesce(last, -1) + 1 + place AS position FROM a LEFT JOIN l USING (playlist_id)""")
def append_positions(t: Tables) -> DataFrame:
    added = t.events.select("event_id", F.col("user_id").alias("playlist_id"), "ts")
    placed = users.append_tracks(playlist_tracks(t), added, "playlist_id", ["ts", "event_id"], F.to_date("ts"))
    return placed.select("event_id", "playlist_id", "position")


@query(f"""SELECT o_orderkey AS playlist_id, {DAY.format(x='greatest(o_orderdate, max(l_shipdate))')} AS updated_at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""")
def playlist_last_touched(t: Tables) -> DataFrame:
    touched = users.last_touched(playlists(t), playlist_tracks(t), "playlist_id")
    return touched.select("playlist_id", stamp("updated_at").alias("updated_at"))


@query("""SELECT l_orderkey AS playlist_id, l_partkey AS song_id, l_linenumber AS position FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))""")
def cascade_delete(t: Tables) -> DataFrame:
    """Tracks left when users, and with them their playlists, are deleted."""
    gone_users = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    gone_lists = playlists(t).join(gone_users, "user_id", "left_semi")
    return users.children_left(playlist_tracks(t), gone_lists, "playlist_id").select("playlist_id", "song_id", "position")


@query("""WITH b AS (SELECT 'Customer#' || lpad(CAST(floor(value * 10) AS BIGINT)::VARCHAR, 9, '0') AS username FROM events WHERE event_type = 'signup')
SELECT username, count(*) AS times, username IN (SELECT c_name FROM customer) AS taken FROM b GROUP BY 1 HAVING count(*) > 1 OR username IN (SELECT c_name FROM customer)""")
def uniqueness_violations(t: Tables) -> DataFrame:
    number = F.lpad(F.floor(F.col("value") * 10).cast("string"), 9, "0")
    batch = t.events.filter("event_type = 'signup'").select(F.concat(F.lit("Customer#"), number).alias("username"))
    return users.violations(batch, t.customer.select(F.col("c_name").alias("username")), "username")


CHANGES = "c AS (SELECT event_id, ts, user_id AS playlist_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, value FROM events)"


@query(f"""WITH {CHANGES}, r AS (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY ts DESC, event_id DESC) AS rk FROM c)
SELECT playlist_id, op, value, {DAY.format(x='ts')} AS updated_at FROM r WHERE rk = 1 AND op <> 'delete'""")
def playlist_snapshot(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "signup", F.lit("create")).when(kind == "error", F.lit("delete")).otherwise(F.lit("update"))
    changes = t.events.select("event_id", "ts", F.col("user_id").alias("playlist_id"), op.alias("op"), "value")
    return users.snapshot(changes, "playlist_id", ["ts", "event_id"]).select("playlist_id", "op", "value", stamp("ts").alias("updated_at"))


@query("""SELECT doc_id, CASE WHEN length(trim(text)) < 1 THEN 'too short' WHEN length(trim(text)) > 255 THEN 'too long' END AS name_error,
CASE WHEN length(trim(lang)) < 3 THEN 'too short' WHEN length(trim(lang)) > 50 THEN 'too long' END AS user_error FROM documents
WHERE length(trim(text)) < 1 OR length(trim(text)) > 255 OR length(trim(lang)) < 3 OR length(trim(lang)) > 50""")
def reject_invalid(t: Tables) -> DataFrame:
    checked = t.documents.select(
        "doc_id", users.text_length_check(F.col("text"), 1, 255).alias("name_error"), users.text_length_check(F.col("lang"), 3, 50).alias("user_error")
    )
    return checked.filter(F.col("name_error").isNotNull() | F.col("user_error").isNotNull())


@query(REPLAY + f", {ENTRIES} SELECT count(*) AS total_keys, count(*) FILTER (expires > (SELECT max(epoch_us(ts)) FROM events)) AS alive_keys FROM entries")
def cache_stats(t: Tables) -> DataFrame:
    as_of = t.events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).scalar()
    return cache.stats(cache_entries(t).withColumn("as_of", as_of), F.col("as_of"))


@query(REPLAY + "SELECT key, id, is_hit FROM walk")
def ttl_cache_hits(t: Tables) -> DataFrame:
    return cache.replay(lookups(t))


@query(REPLAY + "SELECT split_part(key, '|', 2) AS event_type, count(*) FILTER (is_hit) AS hits, count(*) FILTER (NOT is_hit) AS misses FROM walk GROUP BY 1")
def ttl_cache_totals(t: Tables) -> DataFrame:
    kind = F.element_at(F.split("key", r"\|"), 2)
    return cache.replay(lookups(t)).groupBy(kind.alias("event_type")).agg(
        F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses")
    )


@query(with_(HISTORY) + """SELECT id, coalesce(nullif(query_artist, 'view'), '') AS query_artist, 'model1' AS model_used,
 CASE WHEN results_count = 0 THEN 0 ELSE results_count END AS results_count FROM history""")
def history_defaults(t: Tables) -> DataFrame:
    rows = history(t).withColumns(
        {
            "query_artist": F.nullif(F.col("query_artist"), F.lit("view")),
            "model_used": F.lit(None).cast("string"),
            "results_count": F.nullif(F.col("results_count"), F.lit(0)),
        }
    )
    return users.with_defaults(rows).select("id", "query_artist", "model_used", "results_count")
