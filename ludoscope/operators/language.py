"""Language identification in a closed set of two, as Spark jobs: character trigrams counted
where the texts lie, integer log-odds weights, and a sum for each text."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ..scratch import written

#: 1000 ln 19: from here on one language leads the other by at least 0.9 of probability.
CERTAIN = 2944
#: Weights up to which they are broadcast, some 100 MB; more are joined by a shuffle.
BROADCAST = 1 << 20
#: Copies of the weights in that shuffle, so that a common trigram is spread over as many tasks.
SALTS = 64
#: Characters counted at a time; a task holds some 30 bytes for each, beside a batch as it came.
RUN = 1 << 18


def _runs(texts: pa.Array) -> Iterator[tuple[str, list[int], list[int]]]:
    """Texts in a row as one string of about ``RUN`` characters, with the indices of the texts
    and where each begins. A long text comes in parts that share two characters."""
    size, part, index, start = 0, [], [], []
    for i, text in enumerate(texts):  # one text as a Python string at a time, not a batch of them
        text = text.as_py() or ""
        for at in range(0, max(len(text) - 2, 1), RUN):
            piece = text[at : at + RUN + 2]
            part.append(piece)
            index.append(i)
            start.append(size)
            size += len(piece)
            if size >= RUN:
                yield "".join(part), index, start
                size, part, index, start = 0, [], [], []
    if index:
        yield "".join(part), index, start


def _give_back() -> None:
    """Gives memory that a batch has freed back to the system: workers serve one task after
    another, and what each held at its peak would add up in an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def _count(run: str, index: list[int], start: list[int]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """For each text and trigram: the text's index, the trigram, and how often it is there."""
    code = np.frombuffer(run.encode("utf-32-le"), dtype=np.uint32)
    letters = np.flatnonzero(np.bincount(code)) if len(code) else np.zeros(1, np.int64)
    dense = np.zeros(letters[-1] + 1, dtype=np.int64)
    dense[letters] = np.arange(len(letters))
    bits = max(len(letters) - 1, 1).bit_length()  # 21 at most
    c = dense[code]
    owner = np.repeat(np.arange(len(start)), np.diff([*start, len(code)]))
    inside = owner[:-2] == owner[2:]
    gram, owner = (c[:-2] << 2 * bits | c[1:-1] << bits | c[2:])[inside], owner[2:][inside]
    del c, code, inside
    known, width = None, 3 * bits
    if width + len(start).bit_length() > 62:  # too many letters to sort texts and trigrams as one number
        known, gram = np.unique(gram, return_inverse=True)
        width = len(known).bit_length()
    both, n = np.unique(owner << width | gram, return_counts=True)
    met, at = np.unique(both & (1 << width) - 1, return_inverse=True)
    met = met if known is None else known[met]
    mask = (1 << bits) - 1
    spelt = letters[np.stack([met >> 2 * bits, met >> bits & mask, met & mask], axis=1)].astype(np.uint32).tobytes().decode("utf-32-le")
    names = pa.array([spelt[i : i + 3] for i in range(0, len(spelt), 3)], pa.string())
    return np.array(index)[both >> width], names.take(pa.array(at)), n


def lang_ngrams(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, tri, n long``: each three characters in a row of the lower-case text with their
    number there; a long text's numbers may come in several rows. A text of fewer characters
    (null: none) has one row without a trigram, and a number of 0."""
    lower = rows.select(F.col(key).alias("key"), F.lower(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bare = batch.column("key"), np.ones(batch.num_rows, dtype=bool)
            for run in _runs(batch.column("text")):
                at, tri, n = _count(*run)
                bare[at] = False
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), tri, pa.array(n, pa.int64())], ["key", "tri", "n"])
            left = np.flatnonzero(bare)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(left)), pa.nulls(len(left), pa.string()), pa.array(np.zeros(len(left), np.int64))], ["key", "tri", "n"])
            _give_back()

    schema = StructType().add("key", lower.schema["key"].dataType).add("tri", StringType()).add("n", LongType())
    return lower.mapInArrow(count, schema).withColumnRenamed("key", key)


def lang_train(rows: DataFrame, lang: str = "lang", text: str = "text", first: str = "en", second: str = "es") -> DataFrame:
    """``tri, w long``: 1000 times the add-one-smoothed log-odds of ``first`` against
    ``second``, rounded, for each trigram met in texts of the two languages."""
    grams = lang_ngrams(rows.where(F.col(lang).isin(first, second)), lang, text).where("tri is not null")
    counted = grams.groupBy("tri").agg(*(F.sum(F.when(F.col(lang) == x, F.col("n")).otherwise(0)).alias(c) for x, c in ((first, "a"), (second, "b"))))
    one = F.lit(1).alias("__one")
    totals = counted.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count("*").alias("v")).select("*", one)

    def p(c: str, n: str) -> Column:
        return F.ln((F.col(c) + 1) / (F.col(n) + F.col("v")))

    return counted.select("*", one).join(F.broadcast(totals), "__one").select("tri", F.round(1000 * (p("a", "na") - p("b", "nb"))).cast("long").alias("w"))  # one row is broadcast


def lang_score(rows: DataFrame, weights: DataFrame, key: str, text: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """``key, score long``: the sum of a text's weights, 0 without any known trigram. The
    weights are written and counted. Up to ``broadcast`` of them go to all tasks, and a text's
    rows are summed up where they are made; more meet the texts' trigrams in a shuffle, in
    which copies of the weights spread each common trigram."""
    weights = written(weights, "weights")
    grams = lang_ngrams(rows, key, text)
    if weights.count() <= broadcast:
        met = grams.join(F.broadcast(weights), "tri", "left")
    else:
        salted = weights.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = grams.withColumn("__salt", F.pmod(F.xxhash64(key), SALTS).cast("int")).join(salted, ["tri", "__salt"], "left")
    return met.groupBy(key).agg(F.coalesce(F.sum(F.col("n") * F.col("w")), F.lit(0)).alias("score"))


def label(score: Column, first: str = "en", second: str = "es") -> Column:
    """The language that leads far enough, or "unknown"."""
    return F.when(score >= CERTAIN, first).when(score <= -CERTAIN, second).otherwise("unknown")


def filter_language(rows: DataFrame, weights: DataFrame, key: str, text: str = "text", language: str = "en") -> DataFrame:
    """Rows whose text is of a language. ``key`` tells rows apart."""
    fine = lang_score(rows, weights, key, text).where(label(F.col("score")) == language).select(key)
    return rows.join(fine, key, "left_semi")
