"""A corpus pipeline of five of the operators in ludoscope.llm.

``documents`` go through the quality classifier, line dedup, SimHash near-dedup, substring
dedup and best-fit packing. Every stage but the last returns the columns of ``documents``;
each is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludoscope.llm import lines, packing, quality, shingles, substrings
from ludoscope.llm.common import small_batches, table, written

#: Bits of the near-dedup stage's fingerprints, over the distinct words of a text, and in how
#: many two texts may differ to be compared. MinHash keys find those that differ in more.
BITS, DIFFER = 128, 11


def _as_documents(rows: DataFrame) -> DataFrame:
    """The columns of ``documents``, the length set right."""
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good (a score of at least 0.3). Rows
    are scored and kept or dropped where they lie. A null text counts as an empty one."""
    small_batches(spark)  # for all stages
    weights = quality.train(docs, table(spark, sf_dir, "labels"), "quality", held_out=(5, 0))
    scored = quality.score(docs, weights, keep=("text", "lang", "source", "n_chars"), least=0.3)
    return scored.select("doc_id", "text", "lang", "source", "n_chars")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document, or the same one before, has alike.
    Documents that have no line left go; those that were empty before stay."""
    got = lines.dedup(docs, keep=("lang", "source"))
    return _as_documents(got.where((F.col("n_removed") == 0) | (F.trim("text") != "")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a
    similarity of at least 0.8. Rows without an id are all kept."""
    return shingles.without_later(docs, k=DIFFER, bits=BITS).select("doc_id", "text", "lang", "source", "n_chars")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that windows of 20 words cover which start earlier too. A text
    that loses words keeps the others joined by single spaces; the rest stay unchanged.
    Documents that lose all their words go; those that were empty before stay."""
    got = substrings.remove_repeats(docs, length=20, keep=("lang", "source"))
    return _as_documents(got.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).withColumnRenamed("kept", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in as few sequences as can be."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each but the last written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
