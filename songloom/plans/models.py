"""Learning jobs: encoders, zero-shot labels, classifier."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions import numeric as N
from songloom.functions import vectors as V
from songloom.operators import classifier, encoder, evaluate, learning, moods, ranking
from songloom.operators import statistics as S
from songloom.plans.neighbourhood import LABEL_SEARCH
from songloom.plans.preparation import HALVED, split_sql
from songloom.plans.registry import query
from songloom.plans.retrieval import pool_sql
from songloom.plans.scalars import CLEAN, MOOD_SQL
from songloom.plans.twins import TRACKS, with_
from songloom.session import cut_lineage, scratch_path
from songloom.sources import catalogue
from songloom.sources.readers import Tables

def prompts(t: Tables) -> DataFrame:
    """All prompts with vectors: the centroid of half of an embedding label each."""
    listed = F.array(*[F.struct(F.lit(p).alias("prompt"), F.lit(n).alias("label"), F.lit(k).alias("label_type")) for p, n, k in fixed.PICTURE_PROMPTS])
    place = (F.col("label") * 2 + F.col("vec_id") % 2) % len(fixed.PICTURE_PROMPTS)
    cells = t.embeddings.select(place.cast("int").alias("place"), F.posexplode("embedding").alias("dim", "x"))
    means = cells.groupBy("place", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroids = means.groupBy("place").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector"))
    return centroids.select(F.element_at(listed, F.col("place") + 1).alias("p"), "vector").select("p.*", "vector")


PROMPT_ROWS = ", ".join(f"({i}, '{p}', '{n}', '{k}')" for i, (p, n, k) in enumerate(fixed.PICTURE_PROMPTS))
ZERO_SHOT = f"""cell AS (SELECT (label * 2 + vec_id % 2) % {len(fixed.PICTURE_PROMPTS)} AS i, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings),
mean AS (SELECT i, d, avg(x) AS x FROM cell GROUP BY 1, 2),
cent AS (SELECT i, list(x ORDER BY d) AS v FROM mean GROUP BY 1),
score AS (SELECT e.vec_id AS id, prompt, n.label AS label, label_type, 100 * list_cosine_similarity(e.embedding::DOUBLE[], v) AS s
  FROM embeddings e, cent JOIN (VALUES {PROMPT_ROWS}) n(i, prompt, label, label_type) ON n.i = cent.i),
best AS (SELECT id, arg_max(prompt, s) AS prompt, arg_max(label, s) AS label, arg_max(label_type, s) AS label_type, max(s) AS top FROM score GROUP BY 1),
mass AS (SELECT id, sum(exp(s - top)) AS total FROM score JOIN best USING (id) GROUP BY 1),
shot AS (SELECT id, prompt, label, label_type, 1 / total AS confidence FROM best JOIN mass USING (id))"""


def zero_shot(t: Tables) -> DataFrame:
    return learning.zero_shot(t.spread("embeddings", "vec_id").select(F.col("vec_id").alias("id"), "embedding"), prompts(t))


@query(with_(ZERO_SHOT) + "SELECT id, prompt, label, label_type, round(confidence, 6) AS confidence FROM shot")
def zero_shot_label(t: Tables) -> DataFrame:
    return zero_shot(t).withColumn("confidence", F.round("confidence", 6))


LABEL_MOOD = "CASE lower(label) " + " ".join(f"WHEN '{c}' THEN '{m}'" for c, m in fixed.CONTEXT_MOODS.items()) + " ELSE lower(label) END"


@query(with_(ZERO_SHOT, TRACKS, "top AS (" + "SELECT * FROM (" + with_("dummy AS (SELECT 1)")
             + pool_sql(" UNION ALL ".join(f"SELECT '{m}' AS mood, * FROM tracks WHERE {rule}" for m, rule in MOOD_SQL.items()), "mood") + "))")
       + f"SELECT id, label, round(confidence, 6) AS confidence, track_id, rank FROM shot JOIN top ON mood = {LABEL_MOOD}")
def zero_shot_to_songs(t: Tables) -> DataFrame:
    """Picture label, then the top songs of its mood (at most ten per mood)."""
    top = moods.popular_sample(moods.by_every_mood(catalogue.tracks(t)), "mood", 10).select("mood", "track_id", "rank")
    label = F.lower("label")
    mood = F.coalesce(N.lookup(fixed.CONTEXT_MOODS, label), label)
    labelled = zero_shot(t).select("id", "label", F.round("confidence", 6).alias("confidence"), mood.alias("mood"))
    return labelled.join(top, "mood").select("id", "label", "confidence", "track_id", "rank")


@query("WITH shot AS (" + with_(ZERO_SHOT) + "SELECT * FROM shot), near AS (" + LABEL_SEARCH + """)
SELECT id, label, round(confidence, 6) AS confidence, track_id, score, rank FROM shot JOIN near USING (label)""")
def zero_shot_to_tracks(t: Tables) -> DataFrame:
    """Picture label, then the tracks nearest to the profile of that label (at most ten for each)."""
    near = moods.label_search(catalogue.tracks(t)).select(F.col("query_id").alias("label"), F.col("neighbour_id").alias("track_id"), "score", "rank")
    labelled = zero_shot(t).select("id", "label", F.round("confidence", 6).alias("confidence"))
    return labelled.join(near, "label").select("id", "label", "confidence", "track_id", "score", "rank")


LENGTH = "round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 3)"
HAS_WORD = f"length({CLEAN.format(x='text')}) > 0"
VECTOR_SIZE = 64


@query(f"""SELECT doc_id, CASE WHEN vec_id IS NOT NULL THEN 'stored' WHEN {HAS_WORD} THEN 'encoded' ELSE 'empty' END AS origin,
  CASE WHEN vec_id IS NOT NULL THEN {LENGTH} WHEN {HAS_WORD} THEN 1.0 ELSE 0.0 END::DOUBLE AS length, {VECTOR_SIZE} AS dims FROM documents LEFT JOIN embeddings ON doc_id = vec_id""")
def encode_fallback(t: Tables) -> DataFrame:
    """A vector for every document: the stored one, else its encoded text."""
    rows = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left").select(F.col("doc_id").alias("id"), "text", "embedding")
    found = learning.encode_missing(rows, VECTOR_SIZE)
    return found.select(F.col("id").alias("doc_id"), "origin", F.round(V.norm(F.col("embedding")), 3).alias("length"), F.size("embedding").alias("dims"))


@query(f"""SELECT vec_id AS id, {LENGTH} AS length FROM embeddings
UNION ALL SELECT doc_id, CASE WHEN {HAS_WORD} THEN 1.0 ELSE 0.0 END::DOUBLE FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def append_pending(t: Tables) -> DataFrame:
    """The vector table after the documents that it lacked were encoded and appended."""
    folder = scratch_path(t.spark, "vector-table")
    t.embeddings.select(F.col("vec_id").alias("id"), "embedding").write.parquet(folder)
    rows = t.documents.select(F.col("doc_id").alias("id"), "text")
    return learning.append_encoded(rows, folder, VECTOR_SIZE).select("id", F.round(V.norm(F.col("embedding")), 3).alias("length"))


@query()
def pca_encode(t: Tables) -> DataFrame:
    return learning.pca_encode(catalogue.tracks(t)).select("track_id", "embedding")


@query()
def encode_batch(t: Tables) -> DataFrame:
    return learning.encode_batch(catalogue.tracks(t), scratch_path(t.spark, "encoder"))


@query(LABEL_SEARCH)
def label_search_encoded(t: Tables) -> DataFrame:
    """Label search by a model written and read again; with all axes it must find what z-scores find."""
    tracks, folder = catalogue.tracks(t), scratch_path(t.spark, "encoder")
    encoder.fit(tracks, len(fixed.FEATURES)).save(t.spark, folder)
    found = moods.label_search(tracks, encoder=encoder.load(t.spark, folder))
    return found.select(F.col("query_id").alias("label"), F.col("neighbour_id").alias("track_id"), "score", "rank")


@query(with_(TRACKS) + f"SELECT count(*) AS rows, count(*) AS unit_length, true AS closer_with_axes, true AS whole_with_all, {len(fixed.FEATURES)} AS axes_orthogonal FROM tracks")
def encoder_properties(t: Tables) -> DataFrame:
    """What must hold of the codes: length one, errors that fall with each axis to zero, axes at right angles."""
    tracks = catalogue.tracks(t)
    whole = encoder.fit(tracks, len(fixed.FEATURES))
    cut = {k: dataclasses.replace(whole, weights=[w[:k] for w in whole.weights]) for k in (2, 5, 8)}
    errors = {k: e.encode(tracks, "track_id") for k, e in (cut | {len(fixed.FEATURES): whole}).items()}
    checks = [F.count("*").alias("rows"), F.count_if(F.abs(V.norm(F.col("embedding")) - 1) < 1e-5).alias("unit_length")]
    coded = errors[8].agg(*checks)
    falls = [e.agg(F.avg("mse").alias("mse")).scalar() for e in errors.values()]
    closer = (falls[0] > falls[1]) & (falls[1] > falls[2]) & (falls[2] > falls[3])
    angles = np.array(whole.weights).T @ np.array(whole.weights)
    straight = int((np.abs(angles - np.eye(len(angles))) < 1e-9).all(axis=1).sum())
    return coded.select("rows", "unit_length", closer.alias("closer_with_axes"), (falls[3] < 1e-12).alias("whole_with_all"), F.lit(straight).alias("axes_orthogonal"))


@query()
def reconstruction_mse(t: Tables) -> DataFrame:
    return learning.reconstruction_mse(learning.pca_encode(catalogue.tracks(t)))


@query()
def text_vectors(t: Tables) -> DataFrame:
    return learning.text_vectors(catalogue.lyrics(t), "doc_id")


@query()
def train_classifier(t: Tables) -> DataFrame:
    """Classifier trained on the training part, reported on the others."""
    coded = catalogue.tracks(t).withColumn("label", N.emotion_code(F.col("emotion")))
    # split once; weights, statistics and training read the written table
    split = cut_lineage(ranking.exact_split(coded.select("track_id", "label", *fixed.FEATURES), "track_id", ranking.halved_tail_sizes(0.2), ["label"]))
    weights = S.class_weights(split.filter("split = 'train'"), "label")
    predicted = learning.train_classifier(split, weights)
    return evaluate.classification_report(predicted.filter("split <> 'train'"), "label", "predicted")


@query(with_(TRACKS, split_sql("tracks", "track_id", *[x.format(f=0.2) for x in HALVED], by="emotion")) + """SELECT emotion, count(*) AS test_rows, count(*) AS predicted_rows,
  true AS best_of_tried, true AS kept_as_measured, true AS above_majority FROM split WHERE split = 'test' GROUP BY emotion""")
def classifier_choice(t: Tables) -> DataFrame:
    """A classifier chosen on the validation part, saved, loaded and applied to the test part.

    The kept one must be the best tried, give the recorded accuracy again when
    loaded, and beat the most frequent class on the test part.
    """
    rows = catalogue.tracks(t).select("track_id", "emotion", *fixed.FEATURES)
    split = cut_lineage(ranking.exact_split(rows, "track_id", ranking.halved_tail_sizes(0.2), ["emotion"]), "classifier-split")
    chosen, tried = classifier.choose(split, "emotion")
    folder = scratch_path(t.spark, "classifier")
    chosen.save(t.spark, folder)
    kept = classifier.load(t.spark, folder)
    again = classifier.accuracy(kept.predict(split.filter("split = 'val'")), "emotion")
    by_class = kept.predict(split.filter("split = 'test'")).groupBy("emotion").agg(
        F.count("*").alias("test_rows"), F.count("predicted").alias("predicted_rows"), F.count_if(F.col("predicted") == F.col("emotion")).alias("hits")
    )
    above = by_class.agg(F.sum("hits") > F.max("test_rows")).scalar()
    best = all((c.accuracy or 0.0) <= (chosen.accuracy or 0.0) for c in tried)
    facts = [F.lit(best).alias("best_of_tried"), F.lit(again == chosen.accuracy).alias("kept_as_measured"), above.alias("above_majority")]
    return by_class.select("emotion", "test_rows", "predicted_rows", *facts)


@query()
def pc1_gradient(t: Tables) -> DataFrame:
    return learning.first_component(catalogue.tracks(t))


@query()
def effective_rank(t: Tables) -> DataFrame:
    return learning.effective_rank(t.embeddings)


@query("""SELECT vec_id AS id, label, list_position(s, list_max(s)) - 1 AS best FROM (SELECT vec_id, label, embedding::DOUBLE[] AS s FROM embeddings)""")
def argmax_label(t: Tables) -> DataFrame:
    """Index of the highest class score."""
    scores = V.as_doubles(F.col("embedding"))
    return t.embeddings.select(
        F.col("vec_id").alias("id"), "label", (F.array_position(scores, F.array_max(scores)) - 1).alias("best")
    )
