"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.operators.ranking import global_rank
from songloom.plans.registry import query
from songloom.plans.twins import TRACKS, with_
from songloom.session import scratch_path
from songloom.sources import catalogue, sinks
from songloom.sources.readers import Tables, read_any, read_csv


@query("SELECT event_id, user_id, event_type, value FROM events")
def scan_jsonl(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "events") + ".jsonl"
    t.events.select("event_id", "user_id", "event_type", "value").write.json(path)
    return read_any(t.spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@query("SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events WHERE event_id % 5 <> 0")
def scan_jsonl_drift(t: Tables) -> DataFrame:
    """Every fifth line is cut off; numbers come as text in every third, and as something else in every seventh."""
    path = scratch_path(t.spark, "events-drift")
    ident = F.col("event_id")
    value = F.when(ident % 7 == 0, F.lit("x db")).when(ident % 3 == 0, F.col("value").cast("string"))
    drifting = F.to_json(F.struct(ident, F.col("user_id").cast("string").alias("user_id"), "event_type", value.alias("value")))
    plain = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    line = F.when(ident % 5 == 0, F.substring(plain, 1, 20)).when(value.isNotNull(), drifting).otherwise(plain)
    t.events.select(line.alias("value")).write.text(path)
    return read_any(t.spark, path, "event_id bigint, user_id bigint, event_type string, value double", "jsonl")


@query("SELECT doc_id, lang, length(text) AS n, md5(text) AS text_md5 FROM documents")
def scan_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "documents")
    (
        t.documents.select("doc_id", "lang", "text")
        .write.option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path, header=True, escape='"', quoteAll=True)
    )
    rows = read_csv(t.spark, path, "doc_id bigint, lang string, text string")
    return rows.select("doc_id", "lang", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("text_md5"))


@query(with_(TRACKS) + "SELECT track_id, song, artist, year(release_date) AS year, album FROM tracks")
def scan_parquet_meta(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "meta")
    sinks.write_table(
        catalogue.tracks(t).select("track_id", "song", "artist", F.year("release_date").cast("bigint").alias("year"), "album"), path
    )
    return t.spark.read.parquet(path)


@query("SELECT vec_id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def scan_vectors(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "vectors")
    sinks.write_vectors(t.embeddings, path, "vec_id", F.col("embedding"))
    total = F.aggregate(F.col("embedding"), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return t.spark.read.parquet(path).select(
        "vec_id", F.size("embedding").cast("bigint").alias("dim"), F.round(total, 6).alias("total")
    )


@query(with_(TRACKS) + "SELECT song, artist, genre, emotion FROM tracks")
def lite_metadata(t: Tables) -> DataFrame:
    return sinks.lite_metadata(catalogue.tracks(t))


@query("""
SELECT batch, count(*) AS ids, min(p_partkey) AS first_id, max(p_partkey) AS last_id,
  string_agg(p_partkey, ',' ORDER BY p_partkey) AS listed
FROM (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 100 AS batch FROM part)
GROUP BY batch""")
def batch_ids_100(t: Tables) -> DataFrame:
    """Request batches of 100 ids; a group never holds more."""
    ranked = global_rank(t.part.select("p_partkey"), ["p_partkey"])
    return ranked.groupBy(F.floor((F.col("rank") - 1) / 100).alias("batch")).agg(
        F.count("*").alias("ids"),
        F.min("p_partkey").alias("first_id"),
        F.max("p_partkey").alias("last_id"),
        F.array_join(F.sort_array(F.collect_list("p_partkey")), ",").alias("listed"),
    )


@query("SELECT least(count(*), 700) AS rows, least(count(*), 700) AS ids, 0 AS foreign_rows FROM events")
def scan_capped(t: Tables) -> DataFrame:
    """A row cap on a scan of several files: exactly so many rows of the table, none twice."""
    path = scratch_path(t.spark, "events-capped")
    t.events.select("event_id", "event_type").repartition(8, "event_id").write.csv(path, header=True)
    rows = read_csv(t.spark, path, "event_id bigint, event_type string", max_rows=700, multi_line=False)
    known = t.events.select("event_id", "event_type").withColumn("known", F.lit(1))
    met = rows.join(known, ["event_id", "event_type"], "left")
    return met.agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("ids"), F.count_if(F.col("known").isNull()).alias("foreign_rows"))
