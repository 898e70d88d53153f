"""Near-duplicates by exact shingle similarity.

Candidates are what the SimHash probe of operator 6 links and texts that share one of
TABLES keys of MinHash values over their shingles; a pair at a similarity of exactly 0.8
shares one in 99.5 % of cases by simulation, whatever its length. Each candidate is verified
by the sets of its shingles, as 64-bit hashes, before groups are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_pieces, mix, thinned, written
from .graph import bucket_links, components
from .lines import minhashed
from .simhash import RUN, fingerprints, links
from .substrings import word_hashes

#: Keys of a text, the MinHash values in each, texts of a key that are compared pair by pair,
#: and MinHash values in all.
TABLES, SIZE, FEW, VALUES = 32, 6, 16, 48
KEYS = [f"m{i}" for i in range(TABLES // 2)]


def shingle_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Hashes of the n-word shingles of some texts, where those of each text start, and a hash
    of all its words. A text of fewer words has the whole sequence as its one shingle."""
    import xxhash

    words, first = word_hashes(texts, lower=True)
    whole = [xxhash.xxh3_64_intdigest(words[a:b].tobytes()) for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
    m = np.diff(first) - n + 1
    size = np.maximum(m, 1)
    start = np.cumsum(size) - size
    h = np.zeros(int(size.sum()), dtype=np.uint64)
    at = np.arange(len(h)) - np.repeat(start - first[:-1], size)
    real = np.repeat(m > 0, size)
    with np.errstate(over="ignore"):
        own = np.full(int(real.sum()), n, dtype=np.uint64)
        for i in range(n):
            own = mix(own * np.uint64(31) + words[at[real] + i])
    h[real] = own
    h[~real] = np.array(whole, dtype=np.uint64)[m <= 0]
    return h, start, whole


def shingle_set(text: str, n: int) -> tuple[np.ndarray, int]:
    """Hashes of the distinct n-word shingles of a text, in order, and one of all its words."""
    h, _, whole = shingle_hashes([text], n)
    return np.unique(h), whole[0]


def alike(a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether the common shingles are at least the share ``least`` (such as 4, 5) of all."""
    if least[1] * min(len(a), len(b)) < least[0] * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return least[1] * both >= least[0] * (len(a) + len(b) - both)


def _texts(column) -> Iterator[tuple[int, list[str]]]:
    at = 0
    for part in in_pieces(column, RUN):
        yield at, part
        at += len(part)


def near_duplicates(docs: DataFrame, k: int, bits: int, n: int = 5, least: tuple[int, int] = (4, 5), few: int = FEW) -> DataFrame:
    """``t long, keeper long``: each text, by a hash of its words, and the smallest ``doc_id``
    of those it is connected with, itself included, by links at a similarity of ``least``.
    Rows without an id are left out."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in _texts(batch.column(1)):
                h, start, whole = shingle_hashes(part, n)
                with np.errstate(over="ignore"):
                    own = minhashed(((h >> np.uint64(32)).astype(np.uint32), start), SIZE, range(TABLES), n, of=VALUES)
                packed = np.ascontiguousarray(own).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(np.array(whole, dtype=np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(x)) for x in packed.T)], ["doc_id", "t", *KEYS])

    signs = rows.mapInArrow(signed, f"doc_id long, t long, {', '.join(f'{x} long' for x in KEYS)}")
    known = written(signs.groupBy("t").agg(F.min("doc_id").alias("first"), *(F.min(x).alias(x) for x in KEYS)), "texts")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, *own = (c.to_numpy() for c in batch.columns)
            for i, key in enumerate(np.stack(own, axis=1).view(np.uint32).astype(np.int64).T if len(t) else ()):
                yield pa.RecordBatch.from_arrays([pa.array(key * TABLES + i), pa.array(t)], ["key", "t"])

    keys = known.select("t", *KEYS).mapInArrow(keyed, "key long, t long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"), F.bit_xor("t").alias("all")).where("n > 1")
    # keys that the same texts share count once
    shared = written(shared.groupBy("n", "a", "b", "all").agg(F.min("key").alias("key")), "shared")
    members = written(keys.join(shared.where("n > 2").select("key", "n", F.col("a").alias("hub")), "key"), "members")
    some = members.where(F.col("n") <= few).select("key", F.col("t").alias("a"))
    met = some.join(some.withColumnRenamed("a", "b"), "key").select("a", "b")
    hubs = members.where(F.col("n") > few).select(F.col("hub").alias("a"), F.col("t").alias("b"))

    # what operator 6 links, by the texts of smallest id
    prints = written(fingerprints(rows, 1, bits, repeats=False).groupBy("doc_id").agg(F.min("fingerprint").alias("fingerprint")), "prints")
    of = prints.join(known.groupBy(F.col("first").alias("doc_id")).agg(F.min("t").alias("t")), "doc_id").select("t", "fingerprint")
    classes = written(of.groupBy("fingerprint").agg(F.min("t").alias("rep")), "classes")
    equal = of.join(classes, "fingerprint").select(F.col("rep").alias("a"), F.col("t").alias("b"))
    probed = links(classes, k, bits)

    pairs = shared.where("n = 2").select("a", "b").union(met).union(hubs).union(equal).union(probed)
    pairs = written(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("t")).union(pairs.select("b")).union(members.where(F.col("n") > few).select("t")).distinct()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _texts(batch.column(1)):
                own, whole = zip(*(shingle_set(t, n) for t in part), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(whole, dtype=np.uint64).view(np.int64)), pa.array([x.tobytes() for x in own], pa.binary())], ["t", "own"])

    firsts = written(wanted.join(known.select("t", F.col("first").alias("doc_id")), "t").select("doc_id").distinct(), "firsts")
    texts = thinned(rows, "doc_id", bitmap(firsts, "doc_id")).join(firsts, "doc_id", "left_semi").select("doc_id", "text")
    sets = written(texts.mapInArrow(sets_of, "t long, own binary").dropDuplicates(["t"]).join(wanted, "t", "left_semi"), "sets")
    both = pairs.join(sets.select(F.col("t").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("t").alias("b"), F.col("own").alias("y")), "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    near = written(both.select("a", "b", "x", "y").mapInArrow(close, "a long, b long"), "near")
    group = written(components(near), "groups")

    def linked(bucket: pd.DataFrame):
        own = [np.frombuffer(x, np.uint64) for x in bucket["own"]]
        return lambda i, rest: np.array([alike(own[i], own[j], least) for j in rest], dtype=bool)

    # crowds that aren't one group yet
    crowd = members.where(F.col("n") > few).select("key", "t").join(group.withColumnRenamed("node", "t"), "t", "left").withColumn("group", F.coalesce("component", "t"))
    open_ = crowd.groupBy("key").agg(F.count("*").alias("__count"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key", "__count")
    open_ = written(open_, "open")
    rest = crowd.select("key", "t").join(open_.select("key"), "key").join(sets, "t")
    found = components(near.union(bucket_links(rest, ["key"], "t", open_, linked, most=512)))
    of = known.select("t", "first").join(found.withColumnRenamed("node", "t"), "t", "left").withColumn("group", F.coalesce("component", "t"))
    return of.join(of.groupBy("group").agg(F.min("first").alias("keeper")), "group").select("t", "keeper")


def without_later(docs: DataFrame, k: int, bits: int, n: int = 5) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group, or null. Columns may have
    any names."""
    found = written(near_duplicates(docs, k, bits, n), "keepers")
    ids = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = [x for _, part in _texts(batch.column(2)) for x in shingle_hashes(part, n)[2]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(t, dtype=np.uint64).view(np.int64))], ["row", "id", "t"])

    told = ids.mapInArrow(named, ids.drop("text").schema.add("t", "long"))
    rows = told.select("id", "t").where("id is not null").distinct()
    gone = rows.join(found, "t").where("keeper < id").select("id", "t")
    return told.join(gone, ["id", "t"], "left_anti").select("row.*")
