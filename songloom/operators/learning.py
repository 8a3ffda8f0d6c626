"""Vector encoders, zero-shot labels and the emotion classifier."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions import vectors as V
from songloom.functions.text import clean_text
from songloom.operators import encoder
from songloom.operators import statistics as S
from songloom.operators.prepare import pending
from songloom.session import cut_lineage, spread

LOGIT_SCALE = 100.0


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=fixed.FEATURES, outputCol="features").transform(df)


def pca_encode(tracks: DataFrame, k: int = 8) -> DataFrame:
    """Unit-norm latent vectors and the squared error of their reconstruction."""
    return encoder.fit(tracks, k).encode(tracks, "track_id")


def reconstruction_mse(encoded: DataFrame) -> DataFrame:
    return encoded.agg(F.count("*").alias("rows"), F.avg("mse").alias("mse"))


def encode_batch(tracks: DataFrame, folder: str, k: int = 8) -> DataFrame:
    """Fit an encoder, keep it in ``folder``, and encode the table by what was kept."""
    encoder.fit(tracks, k).save(tracks.sparkSession, folder)
    return encoder.load(tracks.sparkSession, folder).encode(tracks, "track_id").select("track_id", "embedding")


def zero_shot(images: DataFrame, prompts: DataFrame, scale: float = LOGIT_SCALE) -> DataFrame:
    """Best label per image vector by softmax over prompt similarities.

    ``prompts`` (prompt, label, label_type, vector) is the small fixed prompt
    list; it enters as one scalar array, so images are only projected.
    """
    listed = prompts.agg(
        F.sort_array(F.collect_list(F.struct("prompt", "label", "label_type", V.unit(F.col("vector")).alias("vector"))))
    ).scalar()
    scored = images.select("id", V.unit(F.col("embedding")).alias("_v"), listed.alias("_prompts")).select(
        "id", "_prompts", F.transform("_prompts", lambda p: V.dot(F.col("_v"), p.getField("vector")) * scale).alias("_scores")
    )
    topped = scored.withColumn("_top", F.array_max("_scores"))
    best = F.element_at("_prompts", F.array_position("_scores", F.col("_top")).cast("int"))
    mass = F.aggregate("_scores", F.lit(0.0), lambda acc, s: acc + F.exp(s - F.col("_top")))
    return topped.select("id", best.alias("_best"), (F.lit(1.0) / mass).alias("confidence")).select(
        "id", "_best.prompt", "_best.label", "_best.label_type", "confidence"
    )


def text_vectors(lyrics: DataFrame, id_col: str, size: int = 256, by_rarity: bool = True) -> DataFrame:
    """Unit-norm hashed TF-IDF vectors of the cleaned text; term counts alone if rarity is not asked for.

    Null texts, and texts without a word, get a zero vector.
    """
    cleaned = lyrics.select(id_col, F.coalesce(clean_text(F.col("lyrics")), F.lit("")).alias("text"))
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+").transform(cleaned)
    counted = HashingTF(inputCol="words", outputCol="counts", numFeatures=size).transform(words)
    weighted = IDF(inputCol="counts", outputCol="weights").fit(counted).transform(counted) if by_rarity else counted
    return Normalizer(inputCol="weights" if by_rarity else "counts", outputCol="unit").transform(weighted).select(
        id_col, vector_to_array("unit", "float32").alias("embedding")
    )


def encode_missing(rows: DataFrame, size: int) -> DataFrame:
    """(id, embedding, origin) of rows (id, text, embedding): stored vectors, else the encoded text.

    A vector that is null, empty or zero counts as missing. An encoded row depends on its own text only, so it is
    the same whenever it is encoded. origin: stored, encoded, or empty for a text without a word (zero vector).
    """
    there = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    stored = rows.filter(there).select("id", F.col("embedding").cast("array<float>").alias("embedding"), F.lit("stored").alias("origin"))
    texts = rows.filter(~there).select("id", F.col("text").alias("lyrics"))
    coded = text_vectors(texts, "id", size, by_rarity=False)
    has_word = F.exists("embedding", lambda x: x != 0)
    return stored.unionByName(coded.withColumn("origin", F.when(has_word, "encoded").otherwise("empty")))


def append_encoded(rows: DataFrame, folder: str, size: int) -> DataFrame:
    """Encode the rows (id, text) whose id the table in ``folder`` lacks, append them to it, and read it again.

    A second run with the same rows appends nothing.
    """
    spark = rows.sparkSession
    stored = spark.read.parquet(folder)
    todo = pending(rows, stored.select("id"), "id").withColumn("embedding", F.lit(None).cast("array<float>"))
    # written apart first: the table cannot be read and appended to in one job
    new = cut_lineage(encode_missing(todo, size).select("id", "embedding"), "encoded")
    new.write.mode("append").parquet(folder)
    return spark.read.schema(stored.schema).parquet(folder)


def train_classifier(tracks: DataFrame, weights: DataFrame, seed: int = 42) -> DataFrame:
    """Emotion classifier with class weights; labels predicted on all splits."""
    train = tracks.filter(F.col("split") == "train")
    stats = S.fit(train, fixed.FEATURES, population=True)
    scaled = assembled(S.apply_zscore(tracks, stats, fixed.FEATURES))
    # read once per training pass, so the joins before it are not repeated
    rows = spread(cut_lineage(scaled.select("track_id", "split", "label", "features")), "track_id")
    weighted = rows.filter(F.col("split") == "train").join(F.broadcast(weights.select("label", "weight")), "label")
    model = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=20, regParam=0.01
    ).fit(weighted)
    return model.transform(rows).select("track_id", "split", "label", F.col("prediction").cast("int").alias("predicted"))


def first_component(tracks: DataFrame) -> DataFrame:
    """Projection on the first principal axis, scaled to 0-1.

    The sign is chosen so that energy counts upwards.
    """
    model = encoder.fit(tracks, 1)
    axis = np.array(model.axes[0])
    if axis[fixed.FEATURES.index("energy")] < 0:
        axis = -axis
    score = V.project(fixed.FEATURES, [axis.tolist()])[0]
    return S.minmax_scale(model.scaled(tracks).select("track_id", score.alias("gradient")), ["gradient"])


def effective_rank(vectors: DataFrame, share: float = 0.99) -> DataFrame:
    """Variance explained by each principal axis and whether it is needed."""
    dim = vectors.select(F.size("embedding")).first()[0]
    rows = vectors.select(array_to_vector(V.as_doubles(F.col("embedding"))).alias("features"))
    explained = PCA(k=dim, inputCol="features", outputCol="latent").fit(rows).explainedVariance.toArray()
    running = np.cumsum(explained)
    needed = int(np.searchsorted(running, share) + 1)
    listed = [(i + 1, float(e), float(c), i + 1 <= needed) for i, (e, c) in enumerate(zip(explained, running))]
    return vectors.sparkSession.createDataFrame(listed, "axis int, explained double, cumulative double, needed boolean")
