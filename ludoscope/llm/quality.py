"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader
updates (operator 1).

The features of a text are n-grams of its words and of their shapes (case, digits, length,
marks, repetition), hashed into a fixed number of weights; their values are shares of the
text's words. A bounded sample of labelled rows is turned into feature counts where the
texts lie and trained in one task; scoring is a sparse dot product for each text where it
lies, so no text is shuffled.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, in_pieces, mix, remainder
from .wording import RUN, Words, segments, words

#: Weights of the model: its size, whatever the corpus.
BUCKETS = 1 << 18
#: Labelled rows that the model is trained on at most, chosen by the hash of their id.
SAMPLE = 16_384
EPOCHS = 6
#: Bytes of text whose n-grams are made at a time, some 60 bytes of memory for each.
AT_ONCE = 250_000


def shapes(w: Words) -> np.ndarray:
    """A small number for the look of each word: marks by their hash, words by case, digits,
    length, and whether they repeat the word before or the one before that."""
    n = len(w.start)
    upper = np.concatenate([[0], np.cumsum((w.cased >= 65) & (w.cased <= 90))])
    digit = np.concatenate([[0], np.cumsum((w.cased >= 48) & (w.cased <= 57))])
    length = w.end - w.start
    ups, digits = upper[w.end] - upper[w.start], digit[w.end] - digit[w.start]
    case = np.where(ups == 0, 0, np.where(ups == 1, 1, 2))
    again = np.zeros(n, dtype=np.int64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    again[2:] |= ((w.hash[2:] == w.hash[:-2]) & (w.text[2:] == w.text[:-2]) & (again[2:] == 0)) * 2
    size = np.minimum(np.where(length > 12, 12, length) // 3, 4)
    code = ((again * 3 + case) * 3 + (digits > 0) + (digits == length)) * 5 + size
    return np.where(w.letters, code, 1000 + (w.hash % np.uint64(4096)).astype(np.int64))


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: the text and the bucket of each n-gram, and the words of each text."""
    parts, which, old = segments(texts, again=4)  # an n-gram of three shapes looks back on four words
    at = 0
    while at < len(parts):
        size, a = 0, at
        while at < len(parts) and (size == 0 or size + len(parts[at]) <= AT_ONCE):
            size += len(parts[at])
            at += 1
        w = words(parts[a:at])
        look = shapes(w).astype(np.uint64)
        new = np.arange(len(w.start)) - np.searchsorted(w.text, w.text) >= old[a:at][w.text]  # words that no part before has
        text, bucket = [], []
        with np.errstate(over="ignore"):
            for kind, (source, orders) in enumerate(((w.hash, (1, 2)), (look, (1, 2, 3)))):
                for n in orders:
                    m = len(source) - n + 1
                    if m <= 0:
                        continue
                    h = np.full(m, np.uint64(kind * 8 + n))
                    for k in range(n):
                        h = h * np.uint64(0x100000001B3) + source[k : k + m]
                    same = (w.text[:m] == w.text[n - 1 :]) & new[n - 1 :]
                    text.append(w.text[:m][same])
                    bucket.append((mix(h[same]) % np.uint64(BUCKETS)).astype(np.int64))
        own = which[a:at]
        text = own[np.concatenate(text)] if text else np.zeros(0, np.int64)
        bucket = np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
        yield text, bucket, np.bincount(own[w.text[new]] if len(w.text) else np.zeros(0, np.int64), minlength=len(texts))


def ftrl(examples: Iterable[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, epochs: int = EPOCHS, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01) -> np.ndarray:
    """Weights (the last one the intercept) by follow-the-regularised-leader updates with a
    rate for each weight, over (buckets, values, label) in the order given, ``epochs`` times."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in examples:
            i = np.append(at, buckets)
            v = np.append(x, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - y) * v
            more = np.sqrt(n[i] + g * g)
            z[i] += g - (more - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(buckets + 1)).astype(np.float32)


#: How far the shares of n-grams are scaled up.
SCALE = 8.0


def sparse(text: np.ndarray, bucket: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one text."""
    at, count = np.unique(bucket, return_counts=True)
    return at, SCALE * count / max(n_words, 1)


def shortened(at: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending buckets and how often each is met, as three bytes for each but the rarest: the
    low 16 bits of buckets, and counts up to 255. How many buckets each value of the high bits
    has, and counts beyond, lead as numbers of four bytes."""
    high = np.bincount(at >> 16, minlength=BUCKETS >> 16)
    often = np.flatnonzero(count > 255)
    head = np.concatenate([high, [len(often)], often, count[often]]).astype("<u4")
    return head.tobytes() + (at & 0xFFFF).astype("<u2").tobytes() + np.minimum(count, 255).astype(np.uint8).tobytes()


def lengthened(raw: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`shortened` was given."""
    n_high = BUCKETS >> 16
    head = np.frombuffer(raw, "<u4", n_high + 1)
    n, n_often = int(head[:n_high].sum()), int(head[n_high])
    by = 4 * (n_high + 1)
    often, more = np.frombuffer(raw, "<u4", 2 * n_often, by).reshape(2, -1)
    by += 8 * n_often
    at = np.frombuffer(raw, "<u2", n, by) + np.repeat(np.arange(n_high) << 16, head[:n_high])
    count = np.frombuffer(raw, np.uint8, n, by + 2 * n).astype(np.int64)
    count[often] = more
    return at, count


class Examples:
    """The sample as it came, three bytes for each n-gram; each text's values are put together
    when it is gone through, so that only one text's are there."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.rows = [(x.as_buffer(), n.as_py(), y.as_py()) for b in batches for x, n, y in zip(b.column(0), b.column(1), b.column(2), strict=True)]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for raw, n_words, y in self.rows:
            at, count = lengthened(raw)
            yield at, (SCALE * count / max(n_words, 1)).astype(np.float32), y


def picked(labels: DataFrame, label: str, held_out: tuple[int, int], most: int, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, y int, h long``: at most ``most`` labelled ids outside the held-out part, those
    of smallest hash. An id labelled more than once counts once, with its larger label."""
    mod, rest = held_out
    fit = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col, mod) != rest))
    return fit.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y")).withColumn("h", F.xxhash64("__id")).orderBy("h", "__id").limit(most)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = (5, 0), most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The model's weights. Without any labelled text they are zeros, and every score 0.5."""
    sample = F.broadcast(picked(labels, label, held_out, most, id_col))  # `most` rows of three numbers at most
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(sample, "__id").select("text", "y", "h")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = list(features([batch.column(0)[k].as_py()]))
                at, count = np.unique(np.concatenate([b for _, b, _ in got]), return_counts=True)
                n_words = int(sum(n.sum() for *_, n in got))
                yield pa.RecordBatch.from_arrays([pa.array([shortened(at, count)], pa.binary()), pa.array([n_words], pa.int64()), batch.column(1).slice(k, 1), batch.column(2).slice(k, 1)], ["x", "n", "y", "h"])
        give_back()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = Examples(batches)
        if examples.rows:
            out = io.BytesIO()
            np.savez(out, w=ftrl(examples))
            del examples
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    # one task trains, on `most` rows; each has a number for each of its buckets, of which there are BUCKETS
    fitted = rows.mapInArrow(counted, "x binary, n long, y int, h long").repartition(1).sortWithinPartitions("h", "x", "y").mapInArrow(fit, "model binary").collect()
    return np.load(io.BytesIO(fitted[0]["model"]))["w"] if fitted else np.zeros(BUCKETS + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), least: float | None = None) -> DataFrame:
    """``id_col, score double`` for each row, and the columns ``keep``; with ``least`` only the
    rows of at least that score, so that the texts of others don't come back from Python. A
    null text is empty and scores by the intercept alone; equal texts score alike; an empty
    table gives an empty one."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS + 1 numbers
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), F.col(id_col), *keep)
    schema = rows.drop("__text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            at = 0
            for part in in_pieces(batch.column(0), RUN):
                dot, n_words = np.zeros(len(part)), np.zeros(len(part))
                for text, bucket, n in features(part):
                    dot += np.bincount(text, weights=w[bucket], minlength=len(part))
                    n_words += n
                logit = float(w[-1]) + SCALE * dot / np.maximum(n_words, 1)
                got = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                out = pa.RecordBatch.from_arrays([*(c.slice(at, len(part)) for c in batch.columns[1:]), pa.array(got)], schema.names)
                yield out if least is None else out.filter(pa.array(got >= least))
                at += len(part)

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = (5, 0), threshold: float = 0.3, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out boolean, score double, predicted int`` for each row of ``docs``.

    Rows whose crc32(id as text) modulo ``held_out[0]`` is ``held_out[1]`` are never learnt
    from; a null id isn't held out. ``predicted`` is 1 from ``threshold`` on.
    """
    got = score(docs, train(docs, labels, label, held_out, most, id_col, text_col), id_col, text_col)
    mod, rest = held_out
    return got.select(id_col, F.coalesce(remainder(id_col, mod) == rest, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
