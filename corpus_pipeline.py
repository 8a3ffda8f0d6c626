"""Training-data pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and reread as the next stage's documents. Stages keep the columns of
documents; the last returns packed pieces. Rows with null or repeated ids, null
or empty texts, ties and extra columns pass like others; what happens to them is
said in each stage. An empty table passes through to an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songloom.llm import language, packing, quality, secrets, simhash
from songloom.llm.common import crc_mod, cut_lineage, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier scores below 0.3. It learns from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return docs.filter(quality.scorer(docs, model)(F.col("text")) >= 0.3)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or far from every language. It learns from rows whose crc32(doc_id) mod 3 is not 1."""
    model = language.fit(docs, F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False)))
    return docs.filter(~language.classifier(docs, model)(F.col("text")).getField("rejected"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: the smallest doc_id (nulls last), of repeated ids the least text hash, of repeated rows one."""
    found = simhash.near_duplicates(docs, words_per_shingle=4, max_bits=4)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("text_hash").isNull().alias("no_text"), "text_hash"))
    keep = cut_lineage(found.groupBy("root").agg(first.alias("k")).select("k.doc_id", "k.text_hash"), "pipeline-keep").alias("k")
    text_hash = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("d"), F.col("doc_id").alias("key"), text_hash.alias("hash")).alias("r")
    kept = rows.join(keep, F.col("r.key").eqNullSafe(F.col("k.doc_id")) & F.col("r.hash").eqNullSafe(F.col("k.text_hash")), "left_semi")
    one = Window.partitionBy("key", "hash").orderBy(F.lit(1))
    return kept.withColumn("n", F.row_number().over(one)).filter("n = 1").select(*[F.col("d").getField(c).alias(c) for c in docs.columns])


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret found; n_chars, where it is a column, follows the new text. No document goes."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").contains(secrets.MASK), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 tokens: one row for each piece, with its sequence and place."""
    return packing.pack(packing.pieces(docs)).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("secret scan", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL: the stages train classifiers and tokenize. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), "pipeline")
    return docs
