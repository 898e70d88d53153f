"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dialogue, embeddings, lines, manifest, packing, personal, quality, simhash, substrings, topk, toxicity, warc
from .common import table

#: Fixed by the contract of operators 9 and 10: the vocabularies and the split pattern.
PACKING_VOCABULARY, CODEC_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", held_out=(5, 0), threshold=0.3)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_and_read(table(spark, sf_dir, "pages"), least=1000)
    # a fault in an archive just written ends the query
    sound = got.withColumn("record_type", F.when(F.col("fault").isNull(), F.col("record_type")).otherwise(F.raise_error(F.col("fault"))))
    return sound.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", held_out=(4, 2), threshold=0.3)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats_digest(table(spark, sf_dir, "documents"), length=20)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, shingle=3, bits=64, seed=42)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"), scale=64)
    return topk.top_k(vectors, vectors.where("id % 20 = 0"), k=20)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_VOCABULARY), capacity=2048, end_id=0)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(CODEC_VOCABULARY), public_tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.prove_tampered(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damage(table(spark, sf_dir, "conversations")))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_warc_round_trip, op3_toxicity, op4_line_dedup, op5_substring_dedup, op6_simhash_near_dedup, op7_embedding_near_dedup, op8_exact_top_k, op9_best_fit_packing, op10_byte_bpe, op11_merkle_manifest, op12_conversation_repair, op13_personal_data)
}
ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": manifest.tampered_sql()}
