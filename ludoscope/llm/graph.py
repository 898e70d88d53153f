"""Links inside buckets, and connected components, for buckets and components of any size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Members of a bucket that one task compares; larger buckets go to many tasks, by pairs of parts.
MOST = 4096


def in_parts(rows: DataFrame, key: list[str], id_col: str, counts: DataFrame, most: int = MOST) -> DataFrame:
    """Adds ``__i, __j`` to the rows of buckets: 0, 0 for a bucket of at most ``most``
    members. A larger one is cut into parts of about half as many by the hash of the id,
    and each member goes to every pair of parts that its own part belongs to, so any two
    members meet in some pair. ``counts`` has ``key`` and ``__count`` of each bucket;
    rows of buckets that it doesn't list are left out."""
    parts = F.when(F.col("__count") > most, F.ceil(F.col("__count") / (most // 2))).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64(id_col, F.lit(7)), F.col("__parts")).cast("int")
    return (
        rows.join(counts, key)
        .withColumn("__parts", parts)
        .withColumn("__own", own)
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        .withColumn("__i", F.least("__own", "__other"))
        .withColumn("__j", F.greatest("__own", "__other"))
        .drop("__count", "__other", "__parts")
    )


def spanning(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of n members: each member that is reached is compared
    with all that aren't yet, so a dense group costs a few comparisons a member and
    gives n - 1 edges. ``linked(i, others)`` tells which others i links with."""
    edges = []
    rest = np.arange(n)
    while len(rest):
        waiting, rest = [int(rest[0])], rest[1:]
        while waiting and len(rest):
            i = waiting.pop()
            hit = linked(i, rest)
            if hit.any():
                found = rest[hit]
                edges += [(i, int(j)) for j in found]
                waiting += found.tolist()
                rest = rest[~hit]
    return edges


def bucket_links(rows: DataFrame, key: list[str], id_col: str, counts: DataFrame, linked: Callable[[pd.DataFrame], Callable[[int, np.ndarray], np.ndarray]], most: int = MOST) -> DataFrame:
    """``a long, b long``: links enough to connect whatever the links inside each bucket
    connect, fewer than a bucket (or a pair of its parts) has members. ``linked`` makes
    the comparison of :func:`spanning` from a bucket's rows."""

    def links(own: pd.DataFrame) -> pd.DataFrame:
        own = own.drop_duplicates(id_col, ignore_index=True)
        ids = own[id_col].to_numpy()
        edges = np.array(spanning(len(own), linked(own)), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ids[edges[:, 0]], "b": ids[edges[:, 1]]})

    return in_parts(rows, key, id_col, counts, most).groupBy(*key, "__i", "__j").applyInPandas(links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node long, component long`` for each node of ``edges`` (a, b): the smallest node it
    is connected with. Rows with a null end are left out.

    Large-star and small-star rounds alternate until nothing changes: each round links
    nodes to smaller neighbours of their neighbours, by partial minima and joins that
    Spark may split, and writes its edges to the shared folder. A node with very many
    neighbours meets them in one join key, which only adaptive skew joins spread. Rounds grow with the logarithm of a component's size.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    seen = _said(now)
    while seen[0]:
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))
        large = now.join(least, "lo").select("hi", F.least("lo", "m").alias("lo")).distinct()
        large = written(large, "edges")
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(first, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = written(small.union(first.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        forget(now, large)
        now, last = after, seen
        seen = _said(now)
        if seen == last:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _said(edges: DataFrame) -> tuple:
    """What tells two sets of edges apart: their number and two sums of hashes."""
    h: Column = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())
