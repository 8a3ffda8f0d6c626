"""Profiling queries: distributions, correlations, densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions import numeric as N
from songloom.operators import density
from songloom.operators import statistics as S
from songloom.operators.quantiles import exact_quantiles, unpivot
from songloom.plans.registry import query
from songloom.plans.twins import FEATURES, LYRICS, RAW, TRACKS, per_feature, with_
from songloom.sources import catalogue
from songloom.sources.readers import Tables

RAW_TYPES = {"track_id": "string", "song": "string", "energy": "double", "danceability": "double", "valence": "double", "tempo": "double"}
DECADE_SQL = "CAST(year(o_orderdate) // 10 * 10 AS INTEGER)"


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(with_(RAW) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{kind}' AS type_name, count(*) AS row_count, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS null_pct FROM raw"
    for c, kind in RAW_TYPES.items()))
def profile_nulls(t: Tables) -> DataFrame:
    return S.null_profile(catalogue.raw_tracks(t))


@query(with_(TRACKS) + per_feature("""SELECT '{n}' AS feature, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean,
CASE WHEN min({c}) IS NULL THEN 'SKIP' WHEN min({c}) >= 0 AND max({c}) <= 1 THEN 'OK' ELSE 'WARN' END AS status FROM tracks"""))
def verify_ranges(t: Tables) -> DataFrame:
    return S.verify_ranges(catalogue.tracks(t), fixed.FEATURES)


def fit_sql(std: str, source: str) -> str:
    return per_feature(f"SELECT '{{n}}' AS feature, round(avg({{c}}), 6) AS mean, round({std}({{c}}), 6) AS std, min({{c}}) AS min, max({{c}}) AS max FROM {source}")


@query(with_(TRACKS) + fit_sql("stddev_pop", "tracks"))
def fit_stats_pop(t: Tables) -> DataFrame:
    return rounded(S.fit_long(catalogue.tracks(t), fixed.FEATURES, population=True), ["mean", "std"])


@query(with_(TRACKS) + fit_sql("stddev_samp", "tracks"))
def fit_stats_samp(t: Tables) -> DataFrame:
    return rounded(S.fit_long(catalogue.tracks(t), fixed.FEATURES, population=False), ["mean", "std"])


@query(with_(TRACKS) + "SELECT genre AS value, count(*) AS rows FROM tracks GROUP BY 1 ORDER BY 2 DESC, 1")
def value_counts(t: Tables) -> DataFrame:
    return catalogue.tracks(t).groupBy(F.col("genre").alias("value")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "value")


@query(with_(TRACKS) + """SELECT "key" AS value, count(*) AS rows, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tracks), 4) AS share FROM tracks GROUP BY 1""")
def category_shares(t: Tables) -> DataFrame:
    counts = catalogue.tracks(t).groupBy(F.col("key").alias("value")).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    shared = S.attach(counts, total).withColumn("share", F.round(F.col("rows") * 100.0 / F.col("_stats.total"), 4))
    return shared.drop("_stats").orderBy("value")


@query("SELECT year(l_shipdate) AS year, count(*) AS rows FROM lineitem GROUP BY 1")
def counts_by_year(t: Tables) -> DataFrame:
    year = N.year_of(F.col("l_shipdate").cast("string")).cast("bigint")
    return t.lineitem.groupBy(year.alias("year")).agg(F.count("*").alias("rows")).orderBy("year")


TAG_RULES = ["p_size > 10", "p_size > 20", "p_size > 30", "p_size > 40", "p_size < 5", "p_retailprice > 950", "p_retailprice > 990", "p_type = 'SMALL'", "p_brand = 'Brand#1'"]


@query("\nUNION ALL\n".join(
    f"SELECT '{tag}' AS tag, CAST(sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS BIGINT) AS tracks, round(sum(CASE WHEN {rule} THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 4) AS coverage FROM lineitem JOIN part ON l_partkey = p_partkey"
    for tag, rule in zip(fixed.TAG_NAMES, TAG_RULES)))
def tag_coverage(t: Tables) -> DataFrame:
    """Context tags as 0/1 text columns, summed leniently."""
    tagged = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        *[F.when(F.expr(rule), F.lit("1")).otherwise(F.lit("0")).alias(f"t{i}") for i, rule in enumerate(TAG_RULES)]
    )
    sums = tagged.agg(F.count("*").alias("n"), *[F.sum(N.to_number(F.col(f"t{i}"))).alias(f"t{i}") for i in range(len(TAG_RULES))])
    rows = F.array(
        *[
            F.struct(
                F.lit(tag).alias("tag"), F.col(f"t{i}").cast("bigint").alias("tracks"),
                F.round(F.col(f"t{i}") * 100.0 / F.col("n"), 4).alias("coverage"),
            )
            for i, tag in enumerate(fixed.TAG_NAMES)
        ]
    )
    return sums.select(F.inline(rows)).orderBy(F.desc("tracks"), "tag")


@query(with_(TRACKS) + "SELECT album AS value, round(avg(popularity), 6) AS mean FROM tracks GROUP BY 1 ORDER BY avg(popularity) DESC, 1 LIMIT 15")
def mean_by_group_topk(t: Tables) -> DataFrame:
    means = catalogue.tracks(t).groupBy(F.col("album").alias("value")).agg(F.avg("popularity").alias("mean"))
    return rounded(means.orderBy(F.desc("mean"), "value").limit(15), ["mean"])


MEANS_SQL = ", ".join(f'round(avg("{f}"), 6) AS "{f}"' for f in FEATURES)


@query(with_(TRACKS) + f"SELECT emotion, {MEANS_SQL} FROM tracks GROUP BY 1")
def group_profile(t: Tables) -> DataFrame:
    return catalogue.tracks(t).groupBy("emotion").agg(*[F.round(F.avg(f), 6).alias(f) for f in fixed.FEATURES])


@query(f"""SELECT {DECADE_SQL} AS decade, count(*) AS orders, round(avg(o_totalprice), 4) AS mean_total FROM orders
WHERE {DECADE_SQL} IN (1960, 1970, 1980, 1990, 2000, 2010, 2020) GROUP BY 1""")
def decade_profile(t: Tables) -> DataFrame:
    decade = N.decade_of(N.year_of(F.col("o_orderdate").cast("string")))
    rows = t.orders.select(decade.alias("decade"), "o_totalprice").filter(F.col("decade").isin(fixed.DECADES))
    return rows.groupBy("decade").agg(F.count("*").alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("mean_total"))


@query(with_(TRACKS) + """, g AS (SELECT emotion, avg(energy) AS e, avg(valence) AS v, count(*) AS cnt FROM tracks GROUP BY 1)
SELECT emotion, round(e, 6) AS energy_mean, round(v, 6) AS valence_mean, cnt, round(cnt / max(cnt) OVER () * 2000 + 80, 6) AS size FROM g""")
def group_bubble(t: Tables) -> DataFrame:
    groups = catalogue.tracks(t).groupBy("emotion").agg(
        F.round(F.avg("energy"), 6).alias("energy_mean"), F.round(F.avg("valence"), 6).alias("valence_mean"), F.count("*").alias("cnt")
    )
    largest = groups.agg(F.max("cnt").alias("top"))
    return S.attach(groups, largest).withColumn("size", F.round(F.col("cnt") / F.col("_stats.top") * 2000 + 80, 6)).drop("_stats")


@query(with_(TRACKS) + """, c AS (SELECT emotion, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, emotion) AS rk FROM tracks GROUP BY 1)
SELECT round(sum(CASE WHEN rk <= 3 THEN n ELSE 0 END) * 100.0::DOUBLE / sum(n), 4) AS top3_share FROM c""")
def top3_share(t: Tables) -> DataFrame:
    counts = catalogue.tracks(t).groupBy("emotion").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "emotion").limit(3).agg(F.sum("n").alias("top"))
    return S.attach(counts.agg(F.sum("n").alias("n")), top).select(F.round(F.col("_stats.top") * 100.0 / F.col("n"), 4).alias("top3_share"))


DESCRIBED = ["energy", "valence", "tempo"]


@query(with_(TRACKS) + per_feature("""SELECT '{n}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max,
round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM tracks""", DESCRIBED))
def describe(t: Tables) -> DataFrame:
    return rounded(S.describe(catalogue.tracks(t), DESCRIBED), ["mean", "std", "q25", "q50", "q75"])


@query(with_(TRACKS) + """SELECT count(*) AS rows, count(DISTINCT emotion) AS emotions, count(DISTINCT song) AS songs, count(DISTINCT album) AS albums,
 strftime(min(release_date), '%Y-%m-%d') AS earliest, strftime(max(release_date), '%Y-%m-%d') AS latest,
 round(avg(popularity), 4) AS popularity_mean, round(quantile_cont(popularity, 0.5), 6) AS popularity_median, round(stddev_samp(popularity), 6) AS popularity_std,
 round(avg(length_ms / 60000), 6) AS minutes_mean, round(quantile_cont(length_ms / 60000, 0.5), 6) AS minutes_median FROM tracks""")
def dataset_summary(t: Tables) -> DataFrame:
    tracks = catalogue.tracks(t).withColumn("minutes", N.minutes(F.col("length_ms")))
    medians = exact_quantiles(tracks, ["popularity", "minutes"], [0.5])
    middle = medians.agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in ("popularity", "minutes")])
    facts = tracks.agg(
        F.count("*").alias("rows"),
        F.count_distinct("emotion").alias("emotions"), F.count_distinct("song").alias("songs"), F.count_distinct("album").alias("albums"),
        F.date_format(F.min("release_date"), "yyyy-MM-dd").alias("earliest"), F.date_format(F.max("release_date"), "yyyy-MM-dd").alias("latest"),
        F.round(F.avg("popularity"), 4).alias("popularity_mean"), F.round(F.stddev_samp("popularity"), 6).alias("popularity_std"),
        F.round(F.avg("minutes"), 6).alias("minutes_mean"),
    )
    return S.attach(facts, middle).select(
        *facts.columns, F.round("_stats.popularity", 6).alias("popularity_median"), F.round("_stats.minutes", 6).alias("minutes_median")
    )


@query(with_(TRACKS) + "\nUNION ALL\n".join(
    f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr("{min(a, b)}", "{max(a, b)}"), 6) AS corr FROM tracks""" for a in FEATURES for b in FEATURES))
def correlation_matrix(t: Tables) -> DataFrame:
    return rounded(S.correlations(catalogue.tracks(t), fixed.FEATURES), ["corr"])


PAIRS = [("energy", "tempo"), ("energy", "acousticness"), ("danceability", "valence"), ("speechiness", "energy"), ("acousticness", "instrumentalness"), ("valence", "energy")]


@query(with_(TRACKS) + "\nUNION ALL\n".join(
    f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr("{a}", "{b}"), 6) AS corr FROM tracks""" for a, b in PAIRS))
def pair_correlations(t: Tables) -> DataFrame:
    return rounded(S.correlations(catalogue.tracks(t), fixed.FEATURES, PAIRS), ["corr"])


@query(with_(TRACKS) + ", q AS (" + per_feature("""SELECT '{n}' AS feature, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75 FROM tracks""", DESCRIBED)
       + "), v AS (" + per_feature("SELECT '{n}' AS feature, {c} AS value FROM tracks", DESCRIBED) + """),
j AS (SELECT *, value BETWEEN q25 - (q75 - q25) * 1.5::DOUBLE AND q75 + (q75 - q25) * 1.5::DOUBLE AS inside FROM v JOIN q USING (feature))
SELECT feature, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, min(value) FILTER (inside) AS whisker_lo, max(value) FILTER (inside) AS whisker_hi,
 count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY ALL""")
def boxplot_stats(t: Tables) -> DataFrame:
    return rounded(S.boxplot(catalogue.tracks(t), DESCRIBED), ["q25", "q50", "q75"])


@query(with_(TRACKS) + per_feature("""SELECT emotion, '{n}' AS feature, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
 round(quantile_cont({c}, 0.75), 6) AS q75 FROM tracks GROUP BY 1""", ["energy", "tempo"]))
def quantiles_by_group(t: Tables) -> DataFrame:
    return rounded(S.quartiles(catalogue.tracks(t), ["energy", "tempo"], ["emotion"]), ["q25", "q50", "q75"])


@query(with_(TRACKS) + """, s AS (SELECT min(popularity) AS lo, max(popularity) AS hi, (max(popularity) - min(popularity)) / 50 AS w FROM tracks),
b AS (SELECT least(CAST(floor((popularity - lo) / w) AS BIGINT), 49) AS bin, count(*) AS rows FROM tracks, s GROUP BY 1)
SELECT g AS bin, round(lo + g * w, 6) AS left_edge, round(lo + (g + 1) * w, 6) AS right_edge, coalesce(rows, 0) AS rows FROM range(50) r(g) CROSS JOIN s LEFT JOIN b ON bin = g""")
def histogram(t: Tables) -> DataFrame:
    return rounded(S.histogram(catalogue.tracks(t), "popularity", 50), ["left_edge", "right_edge"])


@query(with_(TRACKS) + """, s AS (SELECT count(*) AS n, stddev_samp(popularity) * pow(count(*), -0.2::DOUBLE) AS h, min(popularity) AS lo, (max(popularity) - min(popularity)) / 199 AS step FROM tracks),
v AS (SELECT popularity AS value, count(*) AS rows FROM tracks GROUP BY 1)
SELECT g AS point, round(lo + g * step, 6) AS x, round(sum(rows * exp(-0.5::DOUBLE * pow((lo + g * step - value) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 8) AS density
FROM range(200) r(g), s, v GROUP BY g, lo, step""")
def kde_grid(t: Tables) -> DataFrame:
    curve = density.kde(catalogue.tracks(t), "popularity", 200)
    return curve.select("point", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query(with_(TRACKS) + """, s AS (SELECT min(energy) x0, max(energy) x1, min(tempo) y0, max(tempo) y1 FROM tracks)
SELECT least(CAST(floor((energy - x0) / ((x1 - x0) / 60)) AS BIGINT), 59) AS cell_x, least(CAST(floor((tempo - y0) / ((y1 - y0) / 60)) AS BIGINT), 59) AS cell_y,
 count(*) AS rows, round(log10(count(*)), 6) AS log_rows FROM tracks, s GROUP BY 1, 2""")
def density_grid(t: Tables) -> DataFrame:
    return rounded(S.density_grid(catalogue.tracks(t), "energy", "tempo", 60), ["log_rows"])


@query(with_(TRACKS) + """, s AS (SELECT min(tempo) AS t0, max(tempo) AS t1, min(popularity) AS p0, max(popularity) AS p1 FROM tracks)
SELECT track_id, (tempo - t0) / (t1 - t0) AS tempo, (popularity - p0) / (p1 - p0) AS popularity FROM tracks, s""")
def minmax_scale(t: Tables) -> DataFrame:
    columns = ["tempo", "popularity"]
    return S.minmax_scale(catalogue.tracks(t).select("track_id", *columns), columns)


@query(with_(TRACKS) + "SELECT album AS value, count(*) AS rows FROM tracks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_categories(t: Tables) -> DataFrame:
    counts = catalogue.tracks(t).groupBy(F.col("album").alias("value")).agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), "value").limit(20)


@query("""WITH c AS (SELECT CASE WHEN p_type = 'ECONOMY' THEN 'Unknown' ELSE p_type || ' ' || p_brand END AS value FROM lineitem JOIN part ON l_partkey = p_partkey),
top AS (SELECT value FROM (SELECT value, count(*) n FROM c GROUP BY 1 ORDER BY n DESC, value LIMIT 8) WHERE value NOT IN ('Unknown', ''))
SELECT CASE WHEN value IN (SELECT value FROM top) THEN value ELSE 'Other' END AS label, count(*) AS rows FROM c GROUP BY 1""")
def top_or_other(t: Tables) -> DataFrame:
    """The eight most common values, less the unknown ones; the rest is Other."""
    value = F.when(F.col("p_type") == "ECONOMY", F.lit("Unknown")).otherwise(F.concat_ws(" ", "p_type", "p_brand"))
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(value.alias("value"))
    counts = rows.groupBy("value").agg(F.count("*").alias("rows"))
    top = counts.orderBy(F.desc("rows"), "value").limit(8).filter(~F.col("value").isin("Unknown", ""))
    named = counts.join(top.select("value", F.col("value").alias("label")), "value", "left")
    return named.groupBy(F.coalesce("label", F.lit("Other")).alias("label")).agg(F.sum("rows").alias("rows"))


@query("SELECT label, d - 1 AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings) GROUP BY 1, 2")
def vector_dim_stats(t: Tables) -> DataFrame:
    """Mean and population deviation per dimension of a track's segments."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("dim", "x"))
    x = F.col("x").cast("double")
    return cells.groupBy("label", F.col("dim").cast("bigint").alias("dim")).agg(
        F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std")
    )


@query("""SELECT label, count(*) AS num_segments, count(DISTINCT v) AS distinct_segments, round(avg(m), 6) AS avg_loudness
FROM (SELECT label, embedding AS v, list_max(embedding)::DOUBLE AS m FROM embeddings) GROUP BY 1""")
def segment_counts(t: Tables) -> DataFrame:
    """Segment counts and mean of the loudest value per track."""
    rows = t.embeddings.select("label", F.md5(F.col("embedding").cast("string")).alias("v"), F.array_max("embedding").cast("double").alias("m"))
    return rows.groupBy("label").agg(
        F.count("*").alias("num_segments"), F.count_distinct("v").alias("distinct_segments"), F.round(F.avg("m"), 6).alias("avg_loudness")
    )


@query("SELECT 'lang' AS type, string_agg(DISTINCT lang, ',' ORDER BY lang) AS labels FROM documents UNION ALL SELECT 'source', string_agg(DISTINCT source, ',' ORDER BY source) FROM documents")
def labels_by_type(t: Tables) -> DataFrame:
    """Distinct labels per label type; only distinct ones are gathered."""
    pairs = F.array(*[F.struct(F.lit(c).alias("type"), F.col(c).alias("label")) for c in ("lang", "source")])
    distinct = t.documents.select(F.inline(pairs)).distinct()
    return distinct.groupBy("type").agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("labels"))


@query(with_(LYRICS) + "SELECT genre, artist, count(*) AS rows, round(avg(n_chars), 6) AS mean_chars FROM lyrics GROUP BY 1, 2")
def lyrics_length_profile(t: Tables) -> DataFrame:
    return catalogue.lyrics(t).groupBy("genre", "artist").agg(F.count("*").alias("rows"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query(with_(RAW) + per_feature("SELECT '{n}' AS feature, count({c}) AS present, round(sum({c}), 4) AS total FROM raw", ["danceability", "valence"]))
def melted_features(t: Tables) -> DataFrame:
    long = unpivot(catalogue.raw_tracks(t), ["danceability", "valence"])
    return long.groupBy("feature").agg(F.count("value").alias("present"), F.round(F.sum("value"), 4).alias("total"))
