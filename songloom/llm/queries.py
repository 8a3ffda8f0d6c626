"""One query for each operator, applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.llm import byte_bpe, hard_negatives, language, merkle, ngram_join, oracle, packing, permutation, personal, quality, secrets, simhash, suffix_tree, topk
from songloom.llm.common import crc_mod, read_table
from songloom.llm.spans import listed, of_kinds


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = language.fit(docs, F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False)))
    found = language.identify(docs, model)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(read_table(spark, folder, "documents"))).drop("ids")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, folder, "documents"), words_per_shingle=4, max_bits=4)
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op4_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score(read_table(spark, folder, "documents"))


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = byte_bpe.decode(byte_bpe.encode(read_table(spark, folder, "documents")))
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _digest(found: DataFrame, kinds: list[str]) -> DataFrame:
    base = of_kinds(F.col("spans"), kinds)
    counts = [F.size(of_kinds(base, [k])).cast("bigint").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(secrets.scan(read_table(spark, folder, "documents")), secrets.BASE_KINDS)


def op7_personal(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(personal.find(read_table(spark, folder, "documents")), personal.BASE_KINDS)


def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(read_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    model = quality.fit(docs, labels, crc_mod("doc_id", 5) != 0)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return quality.rate(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_permutation(spark: SparkSession, folder: str) -> DataFrame:
    return permutation.neighbours(read_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, folder, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op12_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, folder, "documents"), words=5, num=80, den=100).drop("set_key")


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    found = merkle.manifest(read_table(spark, folder, "documents"))
    root = merkle.folded(F.coalesce("other_leaf", "leaf"), F.col("path"))
    told = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language, op2_packing, op3_simhash, op4_suffix_tree, op5_byte_bpe, op6_secrets, op7_personal, op8_topk, op9_quality, op10_permutation, op11_hard_negatives, op12_ngram_join, op13_manifest)
}
ORACLE_SQL: dict[str, str] = {"op8_topk": oracle.TOP_K, "op11_hard_negatives": oracle.HARD_NEGATIVES, "op12_ngram_join": oracle.NGRAM_JOIN, "op13_manifest": oracle.manifest_sql()}
