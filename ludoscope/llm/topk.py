"""Exact top-k inner products by a three-phase uniform threshold (operator 8).

The components of a vector are dealt to a few lists; a score is the sum of the lists'
partial scores. Phase 1: every block of candidates gives, for each query, the best entries
of each list; the scores of these few are summed up, and the k-th best of them over all
blocks is a score that k candidates reach, hence a safe cutoff. Phase 2: the cutoff goes to
all blocks, and each list gives the entries whose partial score is at least an equal share
of it - a candidate with none such can't reach the cutoff. Phase 3: the partial scores that
these lack are looked up, and the best k of each query kept. A block's lists are formed once a
phase, and no score is summed up but for entries that a list gave. Queries and
candidates meet as blocks of bounded size, one task for each pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .embeddings import usable

#: Queries and candidates in a block; queries of it that are compared at a time.
QUERIES, CANDIDATES, AT_ONCE = 8192, 4096, 1024
#: Lists that the components are dealt to. More lists have smaller shares of the cutoff, which
#: more entries reach: of random vectors, 2,000 candidates and k = 20, two lists give a sixth
#: of all entries in phase 2, four a half.
LISTS = 2
#: Blocks of candidates that one copy of a block of queries meets, where there are MANY of them.
RUN, MANY = 16, 48


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``dim, <name>, <name>_rows``: the rows (``id long, v array<long>``, and ``cutoff long``
    for queries) of each block of about ``size`` in one binary row for each block, with as
    many bytes for a component as the block's largest needs."""
    n = rows.groupBy(F.size("v").alias("dim")).count()
    # a row for each length of vectors; by a shuffle, all vectors of a length would go to one task
    cut = rows.withColumn("dim", F.size("v")).join(F.broadcast(n), "dim").withColumn(name, F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / size)).cast("int"))
    extra = ["cutoff"] if "cutoff" in rows.columns else []

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        v = np.array(own["v"].tolist(), dtype=np.int64)
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= v.min(initial=0) and v.max(initial=0) <= np.iinfo(t).max)
        v = v.astype(kind).tobytes()
        cols = {c: [own[c].to_numpy(dtype=np.int64).tobytes()] for c in ["id", *extra]}
        return pd.DataFrame({"dim": [own["dim"].iloc[0]], name: [own[name].iloc[0]], f"{name}_v": [v], **{f"{name}_{c}": x for c, x in cols.items()}})

    schema = f"dim int, {name} int, {name}_v binary, {name}_id binary" + "".join(f", {name}_{c} binary" for c in extra)
    return cut.select("dim", name, "id", "v", *extra).groupBy("dim", name).applyInPandas(pack, schema)


def n_pairs(queries: DataFrame, candidates: DataFrame, size: int) -> int:
    """Pairs of blocks, about: ``queries`` as rows that go to blocks of ``size``, ``candidates`` as blocks."""
    nq = queries.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / size).alias("nq"))
    both = nq.join(F.broadcast(candidates.groupBy("dim").agg(F.count("*").alias("nc"))), "dim")
    return both.agg(F.sum(F.col("nq") * F.col("nc"))).first()[0] or 0


def meet(queries: DataFrame, candidates: DataFrame, pairs: int) -> DataFrame:
    """Every block of queries beside every block of candidates of the same dimension, ``pairs``
    about. Only numbers of blocks are broadcast. Blocks never are, whatever Spark takes them to
    need, since what meets grows with the square of the table; a task gets a few runs of blocks."""
    run = max(1, min(RUN, pairs // MANY))
    candidates = candidates.withColumn("run", F.floor(F.col("c") / run).cast("int"))
    nq = queries.groupBy("dim").agg(F.collect_set("q").alias("qs"))
    nc = candidates.groupBy("dim").agg(F.collect_set("run").alias("runs"))
    tasks, key = -(-pairs // run) or 1, ["dim", "q", "run"]
    left = queries.join(F.broadcast(nc), "dim").withColumn("run", F.explode("runs")).drop("runs").repartition(tasks, *key)
    right = candidates.join(F.broadcast(nq), "dim").withColumn("q", F.explode("qs")).drop("qs").repartition(tasks, *key)
    return left.join(right.hint("merge"), key).drop("run")


def _vectors(row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of a block."""
    ids = np.frombuffer(row[f"{name}_id"], dtype=np.int64)
    n = len(ids) * row["dim"]
    return ids, np.frombuffer(row[f"{name}_v"], dtype=f"i{len(row[f'{name}_v']) // n}" if n else "i8").reshape(len(ids), row["dim"])


def partial_scores(q: np.ndarray, c: np.ndarray, lists: int) -> Iterator[np.ndarray]:
    """One list after the other, the partial scores of all queries and candidates, exact."""
    cuts = [round(i * q.shape[1] / lists) for i in range(lists + 1)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        x, y = q[:, a:b], c[:, a:b]
        largest = [max(-int(v.min(initial=0)), int(v.max(initial=0))) for v in (x, y)]
        bound = largest[0] * largest[1] * max(b - a, 1)
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64  # exact below these, and faster
        yield x.astype(kind) @ y.astype(kind).T


def looked_up(lists: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """The scores of some entries (places in the matrix of all), summed over the lists."""
    out = np.zeros(len(at), dtype=np.int64)
    for p in lists:
        out += p.ravel()[at].astype(np.int64)
    return out


def best_entries(lists: list[np.ndarray], k: int) -> np.ndarray:
    """Phase 1: places of the ``k`` best entries of each list for each query."""
    rows, n = lists[0].shape
    width = min(k, n)
    row = np.arange(rows)[:, None] * n
    tops = [np.argpartition(p, n - width, axis=1)[:, n - width :] if width < n else np.broadcast_to(np.arange(n), p.shape) for p in lists]
    return np.unique(np.concatenate([(row + t).ravel() for t in tops]))


def sufficient_entries(lists: list[np.ndarray], cutoff: np.ndarray) -> np.ndarray:
    """Phase 2: places of the entries with at least an equal share of the cutoff in some list."""
    share = np.where(cutoff == np.iinfo(np.int64).min, cutoff, -(-cutoff // len(lists)))[:, None]  # rounded up: a sum of integers
    seen = np.zeros(lists[0].shape, dtype=bool)
    for p in lists:
        seen |= p >= share if p.dtype == np.int64 else p >= share.astype(np.float64)  # a rounded share beyond 2^53 is beyond all partial scores too
    return np.flatnonzero(seen)


def _kept(qid: np.ndarray, cid: np.ndarray, at: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    """The best ``k`` of each query of these entries, without its own, ties to the smaller id."""
    a, b = np.divmod(at, max(len(cid), 1))
    out = pd.DataFrame({"query_id": qid[a], "vec_id": cid[b], "score": score})
    out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return out.groupby("query_id").head(k)


def local_best(row: dict, k: int, lists: int) -> Iterator[pd.DataFrame]:
    """Phase 1 for a pair of blocks: entries among the best of some list, with their scores;
    of each query the k best of them. One more than k, since a query may meet itself."""
    (qid, q), (cid, c) = _vectors(row, "q"), _vectors(row, "c")
    for i in range(0, len(qid), AT_ONCE):
        part = slice(i, i + AT_ONCE)
        own = list(partial_scores(q[part], c, lists))
        at = best_entries(own, k + 1)
        yield _kept(qid[part], cid, at, looked_up(own, at), k)


def sufficient(row: dict, k: int, lists: int) -> Iterator[pd.DataFrame]:
    """Phases 2 and 3 for a pair of blocks: entries that reach an equal share of the cutoff in
    some list, with what they lack looked up; those that reach the cutoff, k at most for each
    query."""
    (qid, q), (cid, c) = _vectors(row, "q"), _vectors(row, "c")
    cutoff = np.frombuffer(row["q_cutoff"], dtype=np.int64)
    for i in range(0, len(qid), AT_ONCE):
        part = slice(i, i + AT_ONCE)
        own = list(partial_scores(q[part], c, lists))
        at = sufficient_entries(own, cutoff[part])
        score = looked_up(own, at)
        fine = score >= cutoff[part][at // max(len(cid), 1)]
        yield _kept(qid[part], cid, at[fine], score[fine], k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, lists: int = LISTS, query_block: int = QUERIES, candidate_block: int = CANDIDATES) -> DataFrame:
    """``query_id long, rank int, vec_id long, score long``: the k candidates of highest
    integer inner product for each query, ties to the smaller id; all if they are fewer.

    ``vectors`` and ``queries`` have ``id long, v array<long>``, no nulls. Candidates of a
    query are the vectors of its length with another id. An id that occurs more than once
    counts once, with the smallest of its vectors. Empty tables give an empty one. Scores
    are 64-bit integers; where one lies beyond them it is taken modulo 2^64.
    """
    def once(df: DataFrame) -> DataFrame:
        return df.groupBy("id").agg(F.min("v").alias("v"))

    candidates = written(blocks(once(vectors), candidate_block, "c"), "candidates")
    asked = written(once(queries), "queries")
    pairs = n_pairs(asked, candidates, query_block)
    schema = "query_id long, vec_id long, score long"

    def each(f):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.to_dict("records"):
                    yield from f(row, k, lists)

        return run

    firsts = meet(blocks(asked, query_block, "q"), candidates, pairs).mapInPandas(each(local_best), schema)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoffs = firsts.withColumn("n", F.row_number().over(by)).where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cutoff"))
    with_cutoff = asked.join(cutoffs, "id", "left").fillna({"cutoff": -(2**63)})
    found = meet(blocks(with_cutoff, query_block, "q"), candidates, pairs).mapInPandas(each(sufficient), schema)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id long, v array<long>``: components as floor(scale * x) in double precision; rows
    whose vector is null or holds null or non-finite components, or whose id is null, go.
    A component beyond 64 bits becomes the largest or smallest of them."""
    fine = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    return fine.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
