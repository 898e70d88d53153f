"""Embedding near-duplicates by random-hyperplane signs in several tables (operator 7).

Equal vectors are one class from the start. In each table a class falls into the bucket
of its signs against that table's hyperplanes; all pairs inside a bucket get their exact
cosine in double precision. A pair that meets in several tables counts in the first of
them only, which both members' keys tell, so no list of pairs is ever made or shuffled:
a bucket returns a number for each member and the edges of a spanning forest. Large
buckets are compared by pairs of their parts, in as many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components, in_parts

#: Members of a bucket that one task compares at a time.
MOST = 2048
#: Buckets that go to one task together have about so many members in all.
TOGETHER = 1024


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components; false for null."""
    x = F.transform(vector, lambda v: v.cast("double"))
    return F.coalesce(vector.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def shape_for(n: int, least: float, recall: float, per_bucket: int = 48) -> tuple[int, int]:
    """Signs in a key and tables, for n vectors: buckets of about ``per_bucket`` unrelated
    vectors, and as many tables as find a pair at cosine ``least`` with chance ``recall``."""
    bits = min(30, max(4, round(log2(max(n, 2) / per_bucket))))
    same = (1 - np.arccos(least) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - same)))


def hyperplanes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Normals, dim x (tables * bits)."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def bucket_pairs(x: np.ndarray, keys: np.ndarray, copies: np.ndarray, table: int, least: float, part: np.ndarray, i: int, j: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For the members of one bucket: how many vectors each links with among those it
    doesn't meet in an earlier table, and edges that connect what the bucket's links
    connect. Of a pair of different parts i < j, only pairs across the two count."""
    links = x @ x.T >= least
    np.fill_diagonal(links, False)
    if i != j:
        links &= part[:, None] != part[None, :]
    mine = links
    for t in range(table):
        mine = mine & (keys[:, t][:, None] != keys[:, t][None, :])
    edges = []
    rest = np.ones(len(x), dtype=bool)
    for start in range(len(x)):
        if not rest[start]:
            continue
        rest[start] = False
        waiting = [start]
        while waiting:
            a = waiting.pop()
            found = np.flatnonzero(links[a] & rest)
            rest[found] = False
            edges += [(a, int(b)) for b in found]
            waiting += found.tolist()
    return mine @ copies, edges


def near_duplicates(vectors: DataFrame, least: float = 0.9, recall: float = 0.995, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST, shape: tuple[int, int] | None = None) -> DataFrame:
    """``id_col, n_links long, component_id long, kept boolean`` for each row of ``vectors``.

    Rows link if the cosine of their vectors is at least ``least``; ``recall`` is the
    chance to find a pair at exactly that cosine (closer pairs have more; all pairs of a
    bucket are compared, nothing is capped). Vectors that are null or zero or hold null
    or non-finite components have no links and are kept, and so are vectors of other
    lengths to each other. Equal vectors link with each other; rows that share an id
    count as vectors of their own. A row without an id counts for the links of others
    only through equal vectors with one, and has a null component. An empty table gives
    an empty one; other columns are left out.
    """
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col), F.transform(v, lambda x: x.cast("double")).alias("v"))
    fine = usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    classes = written(rows.where(fine & F.col(id_col).isNotNull()).groupBy("v").agg(F.min(id_col).cast("long").alias("rep"), F.count("*").alias("copies")), "vectors")
    n = classes.count()
    bits, tables = shape or shape_for(n, least, recall)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each table, with the class's keys in all tables."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lengths = np.array([len(x) for x in part.column(0)])
                for dim in np.unique(lengths):
                    own = part.filter(pa.array(lengths == dim))
                    x = own.column(0).flatten().to_numpy().reshape(-1, dim)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    on = (x @ hyperplanes(dim, tables, bits, seed) > 0).reshape(-1, tables, bits)
                    keys = (on @ (1 << np.arange(bits))).astype(np.int32)
                    raw = [r.tobytes() for r in keys]
                    unit = [r.tobytes() for r in x]
                    for t in range(tables):
                        cols = [pa.array(np.full(len(x), t, np.int32)), pa.array(np.full(len(x), dim, np.int32)), pa.array(keys[:, t]), own.column(1), own.column(2), pa.array(raw, pa.binary()), pa.array(unit, pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, ["table", "dim", "key", "rep", "copies", "keys", "unit"])

    keyed = classes.select("v", "rep", "copies").mapInArrow(signs, "table int, dim int, key int, rep long, copies long, keys binary, unit binary")
    counts = keyed.groupBy("table", "dim", "key").agg(F.count("*").alias("__count")).where(F.col("__count") > 1)
    counts = written(counts, "buckets")
    shift = max(0, int(log2(max(1, TOGETHER * 2**bits / max(n, 1)))))
    split = in_parts(keyed, ["table", "dim", "key"], "rep", counts.withColumn("large", F.col("__count") > most), most)
    # a large bucket has a task for each pair of its parts; others share one by the first signs of their keys
    split = split.withColumn("group", F.when(F.col("large"), -1 - F.col("key")).otherwise(F.shiftright("key", shift)))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        table, i, j = (int(group[c].iloc[0]) for c in ("table", "__i", "__j"))
        out = []
        for _, bucket in group.groupby("key"):
            x = np.frombuffer(b"".join(bucket["unit"])).reshape(len(bucket), -1)
            keys = np.frombuffer(b"".join(bucket["keys"]), dtype=np.int32).reshape(len(bucket), -1)
            rep = bucket["rep"].to_numpy()
            linked, edges = bucket_pairs(x, keys, bucket["copies"].to_numpy(), table, least, bucket["__own"].to_numpy(), i, j)
            some = np.flatnonzero(linked)
            out.append(pd.DataFrame({"a": rep[some], "b": rep[some], "n": linked[some]}))
            if edges:
                e = np.array(edges)
                out.append(pd.DataFrame({"a": rep[e[:, 0]], "b": rep[e[:, 1]], "n": 0}))
        return pd.concat(out)

    found = written(split.groupBy("table", "dim", "group", "__i", "__j").applyInPandas(compare, "a long, b long, n long"), "links")
    linked = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    of = classes.join(linked, "rep", "left").join(joined, "rep", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    whole = rows.where(fine & F.col(id_col).isNotNull()).join(of, "v").select(id_col, "n_links", "component_id")
    alone = rows.where(~(fine & F.col(id_col).isNotNull())).select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    return whole.union(alone).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
