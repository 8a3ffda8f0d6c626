"""Nearest-neighbour queries over the embedding table and the track features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions import vectors as V
from songloom.functions.numeric import distance_score
from songloom.operators import moods, neighbours, search
from songloom.operators.index import VectorIndex
from songloom.plans.registry import query
from songloom.plans.retrieval import find_sql, requests
from songloom.plans.twins import FEATURES, TRACKS, VECTORS, with_
from songloom.session import cut_lineage, scratch_path
from songloom.sources import catalogue
from songloom.sources.readers import Tables

L2 = "pow(list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 2)"


def ranked_sql(k: int) -> str:
    return f"""d AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, {L2} AS distance FROM embeddings q, embeddings c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbour_id) AS rank FROM d),
knn AS (SELECT * FROM r WHERE rank <= {k})"""


def vectors(t: Tables) -> DataFrame:
    return t.spread("embeddings", "vec_id").select(F.col("vec_id").alias("id"), "embedding")


@query("WITH " + ranked_sql(5) + " SELECT query_id, neighbour_id, round(distance, 6) AS distance, rank FROM knn")
def knn_l2(t: Tables) -> DataFrame:
    rows = vectors(t)
    return neighbours.knn(rows, rows, 5).select("query_id", "neighbour_id", F.round("distance", 6).alias("distance"), "rank")


COSINE = """d AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(2 - 2 * s, 9), neighbour_id) AS rank FROM d)"""


@query("WITH " + COSINE + " SELECT query_id, neighbour_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 5")
def knn_cosine(t: Tables) -> DataFrame:
    rows = vectors(t)
    return neighbours.knn(rows, rows, 5, "cosine").select("query_id", "neighbour_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("WITH " + ranked_sql(5) + " SELECT query_id, neighbour_id, round(distance, 6) AS distance, rank FROM knn")
def knn_cells(t: Tables) -> DataFrame:
    """The exact search as it runs when the query set is too large to send."""
    rows = vectors(t)
    return neighbours.knn(rows, rows, 5, broadcast_bytes=0).select("query_id", "neighbour_id", F.round("distance", 6).alias("distance"), "rank")


def saved_index(t: Tables, rows: DataFrame) -> VectorIndex:
    return VectorIndex.build(rows, scratch_path(t.spark, "vector-index"))


@query("""SELECT vec_id AS query_id, rank, TRUE AS ascending, TRUE AS is_distance FROM embeddings, (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS rank)""")
def knn_lsh(t: Tables) -> DataFrame:
    """Approximate neighbours by product-quantised codes: five for every vector, nearest first, with their true distances."""
    rows = vectors(t)
    found = saved_index(t, rows).search_codes(rows, 5, cells=1.0)
    both = found.join(rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    both = both.join(rows.select(F.col("id").alias("neighbour_id"), F.col("embedding").alias("c")), "neighbour_id")
    before = F.lag("distance").over(Window.partitionBy("query_id").orderBy("rank"))
    true = V.squared_l2(F.col("q"), F.col("c"))
    return both.select("query_id", "rank", F.coalesce(before <= F.col("distance"), F.lit(True)).alias("ascending"), (F.abs(true - F.col("distance")) < 1e-9).alias("is_distance"))


@query("SELECT 5 AS k, TRUE AS recall_reached, TRUE AS work_bounded")
def knn_recall(t: Tables) -> DataFrame:
    """Whether the search by codes finds 0.9 of the exact neighbours and measures less than a tenth of the vectors a query."""
    rows = vectors(t)
    found = saved_index(t, rows)
    near = found.search_codes(rows, 5, cells=1.0)
    work = near.agg(F.max("measured")).scalar() / found.vectors.agg(F.count("*")).scalar()
    hits = neighbours.recall(near, found.search(rows, 5), 5)
    return hits.select("k", (F.col("recall") >= 0.9).alias("recall_reached"), (work < 0.1).alias("work_bounded"))


@query("WITH " + ranked_sql(5).replace("FROM embeddings q, embeddings c", "FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT * FROM embeddings WHERE vec_id % 10 <> 3) c")
       + " SELECT 1 AS turn, query_id, neighbour_id, round(distance, 6) AS distance, rank FROM knn UNION ALL SELECT * FROM (WITH "
       + ranked_sql(5).replace("FROM embeddings q, embeddings c", "FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings c")
       + " SELECT 2 AS turn, query_id, neighbour_id, round(distance, 6) AS distance, rank FROM knn)")
def index_roundtrip(t: Tables) -> DataFrame:
    """An index is saved, opened and searched; then all vectors come, those it lacks are appended, and it is opened and searched again."""
    rows = vectors(t)
    folder = saved_index(t, rows.filter("id % 10 <> 3")).folder
    queries = rows.filter("id % 20 = 0")
    first = cut_lineage(VectorIndex(t.spark, folder).search(queries, 5).withColumn("turn", F.lit(1)), "turn")
    VectorIndex(t.spark, folder).append(rows)
    second = VectorIndex(t.spark, folder).search(queries, 5).withColumn("turn", F.lit(2))
    return first.unionByName(second).select("turn", "query_id", "neighbour_id", F.round("distance", 6).alias("distance"), "rank")


@query(with_(VECTORS) + ", " + ranked_sql(5) + """ SELECT query_id, neighbour_id, song, artist, genre, emotion, rank, round(1 / (1 + distance), 4) AS score
FROM knn JOIN vectors ON id = neighbour_id""")
def knn_with_metadata(t: Tables) -> DataFrame:
    rows = vectors(t)
    shown = catalogue.song_vectors(t).drop("embedding").withColumnRenamed("id", "neighbour_id")
    found = neighbours.knn(rows, rows, 5).join(shown, "neighbour_id")
    return found.select("query_id", "neighbour_id", "song", "artist", "genre", "emotion", "rank", distance_score(F.col("distance")).alias("score"))


RANGE_SQL = "CASE WHEN hi - lo < 1e-9 THEN {mid} ELSE round({a}::DOUBLE + (x - lo) / (hi - lo) * ({b}::DOUBLE - {a}::DOUBLE), 4) END"


@query("WITH " + COSINE + """, t AS (SELECT query_id, neighbour_id, s AS x FROM r WHERE rank <= 10),
w AS (SELECT *, min(x) OVER (PARTITION BY query_id) AS lo, max(x) OVER (PARTITION BY query_id) AS hi FROM t)
SELECT query_id, neighbour_id, """ + RANGE_SQL.format(mid=0.725, a=0.5, b=0.95) + " AS score FROM w")
def relative_scores(t: Tables) -> DataFrame:
    rows = vectors(t)
    found = neighbours.knn(rows, rows, 10, "cosine")
    return search.relative_scores(found, "similarity", "query_id", fixed.RELATIVE_RANGE).select("query_id", "neighbour_id", "score")


@query("WITH " + ranked_sql(10) + """, t AS (SELECT query_id, neighbour_id, -distance AS x FROM knn),
w AS (SELECT *, min(x) OVER (PARTITION BY query_id) AS lo, max(x) OVER (PARTITION BY query_id) AS hi FROM t)
SELECT query_id, neighbour_id, """ + RANGE_SQL.format(mid=0.815, a=0.65, b=0.98) + " AS score FROM w")
def relative_scores_l2(t: Tables) -> DataFrame:
    rows = vectors(t)
    found = neighbours.knn(rows, rows, 10)
    return search.relative_scores(found, "distance", "query_id", fixed.DISTANCE_RANGE, inverted=True).select("query_id", "neighbour_id", "score")


ALLOWED = "CASE qe " + " ".join(f"WHEN '{e}' THEN {fit}" for e, fit in fixed.COMPATIBLE_EMOTIONS.items()) + " END"


SIMILAR_SONGS = with_(VECTORS) + f""", d AS (SELECT q.id AS query_id, c.id AS neighbour_id, lower(q.song) AS qs, q.emotion AS qe, c.song, c.artist, c.genre, c.emotion,
  pow(list_distance(q.embedding, c.embedding), 2) AS distance FROM vectors q, vectors c),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbour_id) AS rank FROM d) WHERE rank <= 16),
f AS (SELECT *, lower(song) <> qs AS other, lower(song) <> qs AND list_contains({ALLOWED}, emotion) AS ok FROM r),
g AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY query_id) AS n_ok, count(*) FILTER (ok) OVER (PARTITION BY query_id ORDER BY rank) AS ok_rank FROM f)
SELECT query_id, neighbour_id, song, artist, genre, emotion, round(1 / (1 + distance), 4) AS similarity FROM g
WHERE (n_ok > 0 AND ok AND ok_rank <= 5) OR (n_ok = 0 AND rank <= 6 AND other)"""


@query(SIMILAR_SONGS)
def similar_songs(t: Tables) -> DataFrame:
    catalogue_vectors = catalogue.song_vectors(t)
    return search.similar_songs(catalogue_vectors.select("id"), catalogue_vectors)


SIMILAR_TRACKS = with_(VECTORS) + """, d AS (SELECT q.id AS query_id, c.id AS neighbour_id, c.song, c.artist, list_cosine_similarity(q.embedding, c.embedding) AS s FROM vectors q, vectors c),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(2 - 2 * s, 9), neighbour_id) AS rank FROM d) WHERE rank <= 11 AND query_id <> neighbour_id),
t AS (SELECT *, s AS x, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rk FROM r),
w AS (SELECT *, min(x) OVER (PARTITION BY query_id) AS lo, max(x) OVER (PARTITION BY query_id) AS hi FROM t WHERE rk <= 10)
SELECT query_id, neighbour_id, song, artist, """ + RANGE_SQL.format(mid=0.725, a=0.5, b=0.95) + " AS score, rk AS rank FROM w"


@query(SIMILAR_TRACKS)
def similar_tracks(t: Tables) -> DataFrame:
    catalogue_vectors = catalogue.song_vectors(t)
    found = search.similar_tracks(catalogue_vectors.select("id"), catalogue_vectors)
    return found.select("query_id", "neighbour_id", "song", "artist", "score", "rank")


def by_name_sql(found: str, similar: str, columns: str) -> str:
    return f"WITH meant AS ({found}), near AS ({similar}) SELECT request_id, {columns} FROM meant JOIN near ON query_id = pos"


@query(by_name_sql(find_sql(strict=False), SIMILAR_SONGS, "query_id, neighbour_id, near.song, near.artist, similarity"))
def similar_songs_by_name(t: Tables) -> DataFrame:
    """Similar songs of all requests by name, by a part of it, and by name and artist."""
    found = search.similar_songs_by_name(requests(t), catalogue.songs(t), catalogue.song_vectors(t))
    return found.select("request_id", "query_id", "neighbour_id", "song", "artist", "similarity")


@query(by_name_sql(find_sql(strict=True), SIMILAR_TRACKS, "query_id, neighbour_id, near.song, near.artist, score, rank"))
def similar_tracks_by_name(t: Tables) -> DataFrame:
    found = search.similar_tracks_by_name(requests(t), catalogue.songs(t), catalogue.song_vectors(t))
    return found.select("request_id", "query_id", "neighbour_id", "song", "artist", "score", "rank")


PROFILE_ROWS = ", ".join(f"('{name}', {values}::DOUBLE[])" for name, values in fixed.LABEL_PROFILES.items())
Z = ", ".join(f'("{f}" - m_{f}) / (s_{f} + 1e-8)' for f in FEATURES)
Z_PROFILE = ", ".join(f"(v[{i + 1}] - m_{f}) / (s_{f} + 1e-8)" for i, f in enumerate(FEATURES))
STATS = "st AS (SELECT " + ", ".join(f'avg("{f}") AS m_{f}, stddev_samp("{f}") AS s_{f}' for f in FEATURES) + " FROM tracks)"


LABEL_SEARCH = with_(TRACKS, STATS) + f""", p AS (SELECT n AS query_id, [{Z_PROFILE}] AS e FROM (VALUES {PROFILE_ROWS}) x(n, v), st),
c AS (SELECT track_id AS neighbour_id, [{Z}] AS e FROM tracks, st),
d AS (SELECT query_id, neighbour_id, 2 - 2 * list_cosine_similarity(p.e, c.e) AS d FROM p, c),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), neighbour_id) AS rk FROM d) WHERE rk <= 50),
k AS (SELECT *, 1 - d / 2 AS x FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id || '|' || neighbour_id || '-42')) AS pick FROM n) WHERE pick <= 10),
w AS (SELECT *, min(x) OVER (PARTITION BY query_id) AS lo, max(x) OVER (PARTITION BY query_id) AS hi FROM k)
SELECT query_id AS label, neighbour_id AS track_id, """ + RANGE_SQL.format(mid=0.725, a=0.5, b=0.95) + " AS score, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, neighbour_id) AS rank FROM w"


@query(LABEL_SEARCH)
def label_profile_search(t: Tables) -> DataFrame:
    found = moods.label_search(catalogue.tracks(t))
    return found.select(F.col("query_id").alias("label"), F.col("neighbour_id").alias("track_id"), "score", "rank")


@query("SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS length, round(e[1], 6) AS x0, round(e[64], 6) AS x63 FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS e FROM embeddings)")
def l2_normalize(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", V.unit(F.col("embedding")).alias("e"))
    return rows.select("vec_id", F.round(V.dot(F.col("e"), F.col("e")), 6).alias("length"), F.round(F.col("e")[0], 6).alias("x0"), F.round(F.col("e")[63], 6).alias("x63"))


@query("SELECT round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, round(avg(n), 6) AS mean_norm FROM (SELECT sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)")
def norm_check(t: Tables) -> DataFrame:
    norms = t.embeddings.select(V.norm(F.col("embedding")).alias("n"))
    return norms.agg(F.round(F.min("n"), 6).alias("min_norm"), F.round(F.max("n"), 6).alias("max_norm"), F.round(F.avg("n"), 6).alias("mean_norm"))


@query("SELECT doc_id, coalesce(embedding, list_transform(range(64), lambda i: 0.0))[1]::FLOAT::DOUBLE AS x0 FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def vector_lookup(t: Tables) -> DataFrame:
    """Vector by id; zeros where there is none."""
    joined = t.documents.select("doc_id").join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left")
    zeros = F.array_repeat(F.lit(0.0), 64).cast("array<float>")
    return joined.select("doc_id", F.coalesce("embedding", zeros)[0].cast("double").alias("x0"))
