"""Queries over merging, imputing and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.functions import text as X
from songloom.operators import preparation, prepare, ranking
from songloom.operators import statistics as S
from songloom.plans.registry import query
from songloom.plans.twins import LYRICS, RAW, SONGS, TRACKS, with_
from songloom.session import drop_folder, scratch_path, shuffles_freed
from songloom.sources import catalogue, sinks
from songloom.sources.readers import Tables, read_csv

KEY_SQL = "md5(trim(lower(coalesce(artist, ''))) || '|' || trim(lower(coalesce(lyrics, ''))))"


def keyed_lyrics(t: Tables) -> DataFrame:
    """Lyrics with the digest of their merge key, so joins move no text."""
    return catalogue.lyrics(t).withColumn("key", F.md5(X.merge_key(F.col("artist"), F.col("lyrics"))))


@query(with_(LYRICS, f"k AS (SELECT *, {KEY_SQL} AS key FROM lyrics)") + "SELECT doc_id FROM k WHERE key NOT IN (SELECT key FROM k WHERE quality IS NOT NULL)")
def anti_join_unseen(t: Tables) -> DataFrame:
    """Unlabelled copies of labelled lyrics are not added again."""
    rows = keyed_lyrics(t).select("doc_id", "key", "quality")
    return prepare.unseen_rows(rows.filter(F.col("quality").isNotNull()), rows, "key").select("doc_id")


@query(with_(LYRICS, f"k AS (SELECT *, {KEY_SQL} AS key FROM lyrics)") + """
SELECT doc_id, artist, genre FROM k WHERE quality IS NOT NULL
UNION ALL SELECT doc_id, artist, genre FROM k WHERE key NOT IN (SELECT key FROM k WHERE quality IS NOT NULL)""")
def merge_sources(t: Tables) -> DataFrame:
    """The merged catalogue: primary rows and the unseen secondary ones."""
    rows = keyed_lyrics(t).select("doc_id", "artist", "genre", "key", "quality")
    primary = rows.filter(F.col("quality").isNotNull())
    return prepare.union_common(primary, prepare.unseen_rows(primary, rows.drop("quality"), "key")).drop("key")


@query(with_(RAW) + """, side AS (SELECT lower(p_name) AS song, arg_min(p_size / 50, p_partkey) AS d, arg_min(p_retailprice / 2000, p_partkey) AS v,
  arg_min(p_size / 100, p_partkey) AS l FROM part GROUP BY 1)
SELECT track_id, coalesce(danceability, d) AS danceability, coalesce(valence, v) AS valence, l AS liveness
FROM raw LEFT JOIN side ON lower(raw.song) = side.song""")
def enrich_features(t: Tables) -> DataFrame:
    lookup = t.part.select(
        F.lower("p_name").alias("key"), "p_partkey", (F.col("p_size") / 50).alias("danceability"),
        (F.col("p_retailprice") / 2000).alias("valence"), (F.col("p_size") / 100).alias("liveness"),
    )
    left = catalogue.raw_tracks(t).select("track_id", F.lower("song").alias("key"), "danceability", "valence")
    return prepare.enrich(left, lookup, "key", ["danceability", "valence", "liveness"], ["p_partkey"]).drop("key")


@query(with_(SONGS) + "SELECT pos, song, genre FROM songs UNION ALL SELECT doc_id, md5(text), lang FROM documents")
def union_common_columns(t: Tables) -> DataFrame:
    left = catalogue.songs(t).drop("artist")
    right = t.documents.select(F.col("lang").alias("genre"), F.md5("text").alias("song"), F.col("doc_id").alias("pos"), "source")
    return prepare.union_common(left, right)


@query("""SELECT min(doc_id) AS doc_id, md5(text) AS key, arg_min(source, doc_id) AS source FROM documents GROUP BY md5(text)""")
def dedup_keep_first(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.md5("text").alias("key"), "source")
    return ranking.first_per_key(rows, ["key"], ["doc_id"])


@query(with_(SONGS) + "SELECT lower(song) AS key, max(pos) AS pos, arg_max(artist, pos) AS artist FROM songs GROUP BY 1")
def dedup_keep_last(t: Tables) -> DataFrame:
    rows = catalogue.songs(t).select(F.lower("song").alias("key"), "pos", "artist")
    return ranking.first_per_key(rows, ["key"], ["pos"], last=True)


@query(with_(RAW) + """SELECT track_id, coalesce(danceability, (SELECT quantile_cont(danceability, 0.5) FROM raw)) AS danceability,
 coalesce(valence, (SELECT quantile_cont(valence, 0.5) FROM raw)) AS valence FROM raw""")
def impute_median(t: Tables) -> DataFrame:
    columns = ["danceability", "valence"]
    return S.impute_median(catalogue.raw_tracks(t).select("track_id", *columns), columns)


@query("""SELECT e.event_id, CASE event_type WHEN 'error' THEN 'neutral' ELSE event_type END AS emotion,
CASE event_type WHEN 'view' THEN 'Unknown' ELSE event_type END AS genre FROM events e""")
def impute_constant(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    rows = t.events.select("event_id", F.nullif(kind, F.lit("error")).alias("emotion"), F.nullif(kind, F.lit("view")).alias("genre"))
    return S.impute_labels(rows)


def split_sql(source: str, id_col: str, train: str, val: str, by: str = "") -> str:
    over = f"PARTITION BY {by} " if by else ""
    keep = f"{by}, " if by else ""
    whole = f"PARTITION BY {by}" if by else ""
    return f"""r AS (SELECT {id_col}, {keep}row_number() OVER ({over}ORDER BY md5({id_col} || '-42')) AS rk,
  count(*) OVER ({whole}) AS n FROM {source}),
s AS (SELECT *, {train} AS n_train, {val} AS n_val FROM r),
split AS (SELECT {id_col}, {keep}CASE WHEN rk <= n_train THEN 'train' WHEN rk <= n_train + n_val THEN 'val' ELSE 'test' END AS split FROM s)"""


VAL_SHARE = repr(0.1 / 0.9)
HOLDOUT = (f"n - ceil(n * 0.1::DOUBLE) - ceil((n - ceil(n * 0.1::DOUBLE)) * {VAL_SHARE}::DOUBLE)", f"ceil((n - ceil(n * 0.1::DOUBLE)) * {VAL_SHARE}::DOUBLE)")
HALVED = ("n - ceil(n * {f}::DOUBLE)", "ceil(n * {f}::DOUBLE) - ceil(ceil(n * {f}::DOUBLE) * 0.5::DOUBLE)")


@query("WITH " + split_sql("documents", "doc_id", *HOLDOUT) + " SELECT doc_id, split FROM split")
def split_80_10_10(t: Tables) -> DataFrame:
    return ranking.exact_split(t.documents.select("doc_id"), "doc_id", ranking.holdout_sizes(0.1, 0.1))


@query("WITH " + split_sql("orders", "o_orderkey", *[x.format(f=0.1) for x in HALVED]) + " SELECT o_orderkey, split FROM split")
def split_90_5_5(t: Tables) -> DataFrame:
    return ranking.exact_split(t.orders.select("o_orderkey"), "o_orderkey", ranking.halved_tail_sizes(0.1))


@query(with_(TRACKS, split_sql("tracks", "track_id", *[x.format(f=0.2) for x in HALVED], by="emotion")) + "SELECT track_id, emotion, split FROM split")
def split_stratified(t: Tables) -> DataFrame:
    rows = catalogue.tracks(t).select("track_id", "emotion")
    return ranking.exact_split(rows, "track_id", ranking.halved_tail_sizes(0.2), ["emotion"])


@query("WITH " + split_sql("orders", "o_orderkey", *[x.format(f=0.1) for x in HALVED]) + """
SELECT split, count(*) AS rows, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 4) AS share FROM split GROUP BY split""")
def split_sizes(t: Tables) -> DataFrame:
    split = ranking.exact_split(t.orders.select("o_orderkey"), "o_orderkey", ranking.halved_tail_sizes(0.1))
    total = t.orders.agg(F.count("*")).scalar()
    return split.groupBy("split").agg(F.count("*").alias("rows")).withColumn("share", F.round(F.col("rows") * 100.0 / total, 4))


@query("WITH " + split_sql("orders", "o_orderkey", *[x.format(f=0.1) for x in HALVED]) + " SELECT o_orderkey FROM split WHERE split <> 'test'")
def union_splits(t: Tables) -> DataFrame:
    """Training and validation parts together, as an index is built on."""
    split = ranking.exact_split(t.orders.select("o_orderkey"), "o_orderkey", ranking.halved_tail_sizes(0.1))
    train, val = (split.filter(F.col("split") == name).select("o_orderkey") for name in ("train", "val"))
    return train.unionByName(val)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_encodes(t: Tables) -> DataFrame:
    done = t.embeddings.select(F.col("vec_id").alias("doc_id"))
    return prepare.pending(t.documents.select("doc_id"), done, "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '-42'), doc_id LIMIT 250")
def sample_n(t: Tables) -> DataFrame:
    return ranking.sample_exact(t.documents.select("doc_id"), "doc_id", 250)


PREPARED_FEATURES = ["energy", "danceability", "valence", "tempo", "acousticness"]
PREPARED = with_(TRACKS) + """, src AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS track_id,
    p_name AS song, l_quantity / 100 AS energy, nullif(l_tax, 0) AS danceability, nullif(l_discount, 0) AS valence, l_extendedprice AS tempo FROM lineitem JOIN part ON l_partkey = p_partkey),
first AS (SELECT lower(p_name) AS name, CASE WHEN p_partkey % 2 = 0 THEN p_size / 50 END AS d, p_size / 100 AS a FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1),
rich AS (SELECT track_id, energy, coalesce(danceability, d) AS danceability, valence, tempo, a AS acousticness FROM src LEFT JOIN first ON lower(song) = name),
whole AS (SELECT r.track_id, CASE WHEN t.emotion = 'fear' THEN 'neutral' ELSE t.emotion END AS emotion, r.energy, coalesce(r.danceability, (SELECT quantile_cont(danceability, 0.5) FROM rich)) AS danceability,
  coalesce(r.valence, (SELECT quantile_cont(valence, 0.5) FROM rich)) AS valence, r.tempo, r.acousticness FROM rich r JOIN tracks t USING (track_id)),
""" + split_sql("whole", "track_id", *[x.format(f=0.2) for x in HALVED], by="emotion")


def prepared_folder(t: Tables) -> str:
    """Two raw sources of other names, units and formats, prepared and written; what only the job itself reads is dropped."""
    with shuffles_freed(t.spark):
        return _prepared_folder(t)


def _prepared_folder(t: Tables) -> str:
    tracks = t.spread("lineitem", "l_orderkey").join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    emotion = catalogue.emotion_by_number(F.col("l_linenumber"))
    mood = F.when(emotion != "fear", emotion)
    tax, discount = F.nullif("l_tax", F.lit(0.0)), F.nullif("l_discount", F.lit(0.0))
    raw = {
        "first": (F.col("l_linenumber") <= 4, [catalogue.track_id().alias("track_id"), F.col("p_name").alias("song"), F.col("s_name").alias("Artist(s)"), mood.alias("emotion"),
                  F.col("l_quantity").alias("Energy"), tax.alias("Danceability"), discount.alias("Positiveness"), F.col("l_extendedprice").alias("Tempo")]),
        "second": (F.col("l_linenumber") >= 3, [catalogue.track_id().alias("track_id"), F.col("p_name").alias("name"), F.col("s_name").alias("artists"), mood.alias("emotion"),
                   (F.col("l_quantity") / 100).alias("energy"), tax.alias("danceability"), discount.alias("valence"), F.col("l_extendedprice").alias("tempo"), F.lit("x").alias("only_here")]),
    }
    folder, sources = scratch_path(t.spark, "prepared"), {}
    for place, (rows, columns) in raw.items():
        path = f"{folder}/raw-{place}"
        chosen = tracks.filter(rows).select(*columns)
        chosen.write.options(**sinks.PACKED).csv(path, header=True)
        # as collected: every field is text
        sources[place] = read_csv(t.spark, path, ", ".join(f"`{c}` string" for c in chosen.columns), multi_line=False)
    lookup = t.part.select(F.col("p_name").alias("song"), "p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 50).alias("danceability"), (F.col("p_size") / 100).alias("acousticness"))
    required = ["track_id", "song", "artist", "emotion", "energy", "danceability", "valence", "tempo"]
    done = preparation.prepared(
        sources["first"], sources["second"], lookup, F.col("track_id"), F.lower("song"), "p_partkey", "track_id", PREPARED_FEATURES, required,
        f"{folder}/scratch", names=(),  # not written
    )
    for place in raw:
        drop_folder(t.spark, f"{folder}/raw-{place}")
    preparation.write(done.select("track_id", "emotion", *PREPARED_FEATURES, "split"), folder, PREPARED_FEATURES)
    drop_folder(t.spark, f"{folder}/scratch")
    return folder


@query(PREPARED + " SELECT w.*, split FROM whole w JOIN split USING (track_id)")
def prepared_catalogue(t: Tables) -> DataFrame:
    """Load, harmonise, merge, enrich, impute, split, write; then the written parts."""
    schema = "track_id string, emotion string, " + ", ".join(f"{f} double" for f in PREPARED_FEATURES)
    return preparation.written(t.spark, prepared_folder(t), schema)


@query(PREPARED + ", train AS (SELECT whole.* FROM whole JOIN split USING (track_id) WHERE split = 'train') " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS std, min({f}) AS min, max({f}) AS max FROM train" for f in PREPARED_FEATURES))
def prepared_statistics(t: Tables) -> DataFrame:
    """The training part's statistics that the same job wrote."""
    rows = preparation.written_statistics(t.spark, prepared_folder(t))
    return rows.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})
