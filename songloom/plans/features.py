"""Feature scaling, vocabularies, triplets and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions import numeric as N
from songloom.functions import text as X
from songloom.operators import evaluate, neighbours, triplets, vocabulary
from songloom.operators import statistics as S
from songloom.plans.neighbourhood import ranked_sql
from songloom.plans.registry import query
from songloom.plans.twins import FEATURES, SONGS, TRACKS, with_
from songloom.sources import catalogue
from songloom.sources.readers import Tables


def zscore_sql(std: str) -> str:
    stats = "st AS (SELECT " + ", ".join(f'avg("{f}") AS m_{f}, {std}("{f}") AS s_{f}' for f in FEATURES) + " FROM tracks)"
    scaled = ", ".join(f'round(("{f}" - m_{f}) / (s_{f} + 1e-8), 6) AS "{f}"' for f in FEATURES)
    return with_(TRACKS, stats) + f"SELECT track_id, {scaled} FROM tracks, st"


def scaled(t: Tables, population: bool) -> DataFrame:
    tracks = catalogue.tracks(t)
    rows = S.apply_zscore(tracks, S.fit(tracks, fixed.FEATURES, population), fixed.FEATURES)
    return rows.select("track_id", *[F.round(f, 6).alias(f) for f in fixed.FEATURES])


@query(zscore_sql("stddev_pop"))
def zscore_pop(t: Tables) -> DataFrame:
    return scaled(t, population=True)


@query(zscore_sql("stddev_samp"))
def zscore_samp(t: Tables) -> DataFrame:
    return scaled(t, population=False)


@query(with_(SONGS, "v AS (SELECT song AS value, min(pos) AS p FROM songs GROUP BY 1)")
       + "SELECT value, row_number() OVER (ORDER BY p) - 1 AS idx FROM v UNION ALL SELECT '<UNK>', count(*) FROM v")
def vocab_first_seen(t: Tables) -> DataFrame:
    return vocabulary.fit_first_seen(catalogue.songs(t), "song", "pos")


@query(with_(SONGS) + "SELECT song AS value, row_number() OVER (ORDER BY song) - 1 AS idx FROM (SELECT DISTINCT song FROM songs)")
def vocab_sorted(t: Tables) -> DataFrame:
    return vocabulary.fit_sorted(catalogue.songs(t), "song")


@query(with_(TRACKS, SONGS, "v AS (SELECT artist AS value, row_number() OVER (ORDER BY min(pos)) - 1 AS idx FROM songs GROUP BY 1)")
       + """SELECT track_id, coalesce(idx, (SELECT count(*) FROM v)) AS genre_idx,
 CASE WHEN emotion = 'joy' THEN 3 WHEN emotion = 'anger' THEN 11 ELSE 0 END AS key_idx FROM tracks LEFT JOIN v ON value = CASE WHEN genre = 'SMALL' THEN 'none' ELSE album END""")
def vocab_apply(t: Tables) -> DataFrame:
    """Vocabulary indices; unseen values and unknown keys get the defaults."""
    words = vocabulary.fit_first_seen(catalogue.songs(t), "artist", "pos")
    rows = catalogue.tracks(t).select(
        "track_id",
        F.when(F.col("genre") == "SMALL", F.lit("none")).otherwise(F.col("album")).alias("word"),
        F.when(F.col("emotion") == "joy", F.lit("D#")).when(F.col("emotion") == "anger", F.lit("11")).otherwise(F.lit("Eb")).alias("key"),
    )
    applied = vocabulary.apply_vocabulary(rows, words, "word", "genre_idx")
    return applied.select("track_id", "genre_idx", N.key_index(F.col("key")).alias("key_idx"))


LABELS = ", ".join(f"({c}, '{e}')" for e, c in fixed.EMOTION_CODES.items())
CODE_SQL = "CASE emotion " + " ".join(f"WHEN '{e}' THEN {c}" for e, c in fixed.EMOTION_CODES.items()) + " END"
WEIGHTS_SQL = f"""w AS (SELECT label, emotion, rows, total / (6 * greatest(rows, 1)) AS raw FROM (
  SELECT l.label, l.emotion, count(c.code) AS rows, (SELECT count(*) FROM coded) AS total FROM (VALUES {LABELS}) l(label, emotion) LEFT JOIN coded c ON c.code = l.label GROUP BY 1, 2))"""


@query(with_(TRACKS, f"coded AS (SELECT {CODE_SQL} AS code FROM tracks)", WEIGHTS_SQL)
       + "SELECT label, emotion, rows, round(raw / (SELECT sum(raw) FROM w) * 6, 6) AS weight FROM w")
def class_weights(t: Tables) -> DataFrame:
    """A label without rows counts as if it had one."""
    coded = catalogue.tracks(t).select(N.emotion_code(F.col("emotion")).alias("code"))
    return S.class_weights(coded, "code").withColumn("weight", F.round("weight", 6))


@query("SELECT count(*) AS rows, round(avg(CASE WHEN toxic = 1 - quality THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM labels")
def accuracy(t: Tables) -> DataFrame:
    rows = t.labels.withColumn("predicted", 1 - F.col("quality"))
    return evaluate.accuracy(rows, "toxic", "predicted").withColumn("accuracy", F.round("accuracy", 6))


REPORT = """, c AS (SELECT y, p, count(*) AS n FROM pairs GROUP BY 1, 2),
k AS (SELECT y AS name FROM c UNION SELECT p FROM c),
s AS (SELECT name, (SELECT coalesce(sum(n), 0) FROM c WHERE y = name) AS support, (SELECT coalesce(sum(n), 0) FROM c WHERE p = name) AS called,
  (SELECT coalesce(sum(n), 0) FROM c WHERE y = name AND p = name) AS hits FROM k),
r AS (SELECT name, CASE WHEN called = 0 THEN 0 ELSE hits / called END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall, support FROM s),
f AS (SELECT name::VARCHAR AS name, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM r),
u AS (SELECT * FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM u"""
GUESS_SQL = f"CASE WHEN energy > 0.8::DOUBLE THEN 0 WHEN valence < 0.2::DOUBLE THEN 1 WHEN speechiness > 0.5::DOUBLE THEN {CODE_SQL} ELSE 3 END"


@query(with_(TRACKS, f"pairs AS (SELECT {CODE_SQL} AS y, {GUESS_SQL} AS p FROM tracks)") + REPORT)
def classification_report(t: Tables) -> DataFrame:
    """Report for a rule that guesses the emotion from three features."""
    guess = (
        F.when(F.col("energy") > 0.8, 0).when(F.col("valence") < 0.2, 1).when(F.col("speechiness") > 0.5, N.emotion_code(F.col("emotion"))).otherwise(3)
    )
    rows = catalogue.tracks(t).select(N.emotion_code(F.col("emotion")).alias("y"), guess.alias("p"))
    report = evaluate.classification_report(rows, "y", "p")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(with_("pairs AS (SELECT toxic AS y, 1 - quality AS p FROM labels)") + REPORT)
def label_report(t: Tables) -> DataFrame:
    report = evaluate.classification_report(t.labels.withColumn("p", 1 - F.col("quality")), "toxic", "p")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# --- triplets ---------------------------------------------------------------------


def songs_with_neighbours(t: Tables) -> DataFrame:
    """Songs with up to three similar songs, taken from the embeddings."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    near = neighbours.knn(rows, rows, 4).filter(F.col("query_id") != F.col("neighbour_id")).filter("rank <= 4")
    shown = catalogue.songs(t).select(F.col("pos").alias("neighbour_id"), "artist", "song")
    listed = near.join(shown, "neighbour_id").groupBy(F.col("query_id").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "artist", "song"))), lambda s: F.struct(s["artist"], s["song"])).alias("similar")
    )
    return catalogue.songs(t).select(F.col("pos").alias("id"), "artist", "song", "genre").join(listed, "id", "left")


def songs(t: Tables) -> DataFrame:
    return catalogue.songs(t).select(F.col("pos").alias("id"), "artist", "song", "genre")


def draw_sql(id_col: str, seed: int) -> str:
    return f"('0x' || substr(md5({id_col} || '-{seed}'), 1, 8))::BIGINT"


POSITIVES = """near AS (SELECT query_id, neighbour_id, rank FROM knn WHERE query_id <> neighbour_id),
keys AS (SELECT lower(artist) || '|' || lower(song) AS key, max(pos) AS positive_id FROM songs GROUP BY 1),
listed AS (SELECT query_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, lower(artist) || '|' || lower(song) AS key FROM near JOIN songs ON pos = neighbour_id WHERE query_id IN (SELECT pos FROM songs)),
pos_listed AS (SELECT id, arg_min(positive_id, place) AS positive_id FROM listed JOIN keys USING (key) WHERE place <= 3 GROUP BY id)"""
RANKS = """gr AS (SELECT pos AS id, lower(genre) AS genre, row_number() OVER (PARTITION BY lower(genre) ORDER BY md5(pos || '-42'), pos) - 1 AS place,
  count(*) OVER (PARTITION BY lower(genre)) AS n FROM songs)"""
SAME = f"""same AS (SELECT a.id, b.id AS positive_id FROM gr a JOIN gr b ON a.genre = b.genre AND b.place = (a.place + 1 + {draw_sql('a.id', 1)} % (a.n - 1)) % a.n WHERE a.n > 1)"""
OTHER = f"""gn AS (SELECT genre, count(*) AS rows, row_number() OVER (ORDER BY genre) - 1 AS number FROM gr GROUP BY 1),
aim AS (SELECT gr.id, (number + 1 + {draw_sql('gr.id', 2)} % ((SELECT count(*) FROM gn) - 1)) % (SELECT count(*) FROM gn) AS number FROM gr JOIN gn USING (genre)),
other AS (SELECT aim.id, gr.id AS negative_id FROM aim JOIN gn USING (number) JOIN gr ON gr.genre = gn.genre AND gr.place = {draw_sql('aim.id', 3)} % gn.rows)"""


@query(with_(SONGS, ranked_sql(4), POSITIVES) + "SELECT id, positive_id FROM pos_listed")
def triplet_positives(t: Tables) -> DataFrame:
    return triplets.positives(songs_with_neighbours(t))


@query(with_(SONGS, RANKS, SAME) + "SELECT id, positive_id FROM same")
def triplet_positive_fallback(t: Tables) -> DataFrame:
    return triplets.same_genre(songs(t))


@query(with_(SONGS, RANKS, OTHER) + "SELECT id, negative_id FROM other")
def triplet_negatives(t: Tables) -> DataFrame:
    return triplets.other_genre(songs(t))


MINED = "mined AS (SELECT pos AS anchor_id, coalesce(p.positive_id, f.positive_id) AS positive_id, negative_id FROM songs LEFT JOIN pos_listed p ON p.id = pos LEFT JOIN same f ON f.id = pos JOIN other o ON o.id = pos WHERE coalesce(p.positive_id, f.positive_id) IS NOT NULL)"


@query(with_(SONGS, ranked_sql(4), POSITIVES, RANKS, SAME, OTHER, MINED) + "SELECT anchor_id, positive_id, negative_id FROM mined")
def mine_triplets(t: Tables) -> DataFrame:
    return triplets.mine(songs_with_neighbours(t))


@query(with_(SONGS, RANKS, SAME, OTHER) + """, d AS (SELECT list_distance(a.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS dp, list_distance(a.embedding::DOUBLE[], n.embedding::DOUBLE[]) AS dn
 FROM same JOIN other USING (id) JOIN embeddings a ON a.vec_id = same.id JOIN embeddings p ON p.vec_id = same.positive_id JOIN embeddings n ON n.vec_id = other.negative_id)
SELECT count(*) AS triplets, round(avg(greatest(0, dp - dn + 0.3::DOUBLE)), 6) AS loss FROM d""")
def triplet_margin(t: Tables) -> DataFrame:
    rows = songs(t)
    drawn = triplets.same_genre(rows).join(triplets.other_genre(rows), "id").withColumnRenamed("id", "anchor_id")
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return triplets.margin_loss(drawn, vectors).withColumn("loss", F.round("loss", 6))


TRAINING_STATS = "st AS (SELECT " + ", ".join(f'avg("{f}") AS m_{f}, stddev_pop("{f}") AS s_{f}' for f in FEATURES) + " FROM tracks)"
TRAINING_COLUMNS = ", ".join(f'round(("{f}" - m_{f}) / (s_{f} + 1e-8), 6) AS "{f}"' for f in FEATURES)


@query(with_(TRACKS, TRAINING_STATS, "v AS (SELECT genre AS value, row_number() OVER (ORDER BY genre) - 1 AS idx FROM (SELECT DISTINCT genre FROM tracks))")
       + f"""SELECT track_id, '[EMOTION: ' || emotion || '] [GENRE: ' || genre || '] ' || lower(song) AS text, {TRAINING_COLUMNS},
 idx AS genre_idx, {CODE_SQL} AS emotion_idx, CAST(round("key" * 11) AS INTEGER) AS key_idx FROM tracks JOIN v ON genre = value, st""")
def training_frame(t: Tables) -> DataFrame:
    """Text, scaled features and the three label indices of every track."""
    tracks = catalogue.tracks(t)
    words = vocabulary.fit_sorted(tracks, "genre")
    rows = tracks.select(
        "track_id", X.combine_text(X.clean_text(F.col("song")), F.col("emotion"), F.col("genre")).alias("text"), "genre",
        N.emotion_code_lenient(F.col("emotion")).alias("emotion_idx"), N.key_index(F.round(F.col("key") * 11).cast("int").cast("string")).alias("key_idx"),
        *fixed.FEATURES,
    )
    numbered = vocabulary.apply_vocabulary(rows, words, "genre", "genre_idx", unknown=0)
    final = S.apply_zscore(numbered, S.fit(tracks, fixed.FEATURES, population=True), fixed.FEATURES)
    return final.select("track_id", "text", *[F.round(f, 6).alias(f) for f in fixed.FEATURES], "genre_idx", "emotion_idx", "key_idx")
