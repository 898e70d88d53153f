"""SimHash near-duplicates by generalised pigeonhole (operator 6).

Equal fingerprints are one class from the start. The bits are grouped into partitions
of correlated bits, from the bit counts of all fingerprints. Each fingerprint gets a
threshold of its own for each partition, allocated by dynamic programming on the
candidates it would meet there, which histograms of all fingerprints estimate. By the
general pigeonhole principle two fingerprints that differ in at most k bits differ in at
most t_i bits in some partition i as soon as the thresholds sum to k - m + 1 (-1: the
partition isn't probed). Partitions are probed at their thresholds, what is found is
verified on all bits. A value that many fingerprints share is searched for a spanning
forest of its links instead of all its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, written
from .graph import bucket_links, components

#: Characters whose shingles are hashed at a time.
RUN = 1_000_000
#: Bits of a partition that its histogram tells apart.
COARSE = 12
#: Fingerprints with one value in a partition up to which they are compared pair by pair.
FEW = 32

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(text: str, most: int = RUN) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, in runs that keep memory bounded."""
    raw = text.encode().lower()
    a = 0
    while len(raw) - a > most and (m := _SPACE.search(raw, a + most)):
        yield raw[a : m.start()].split()
        a = m.start()
    yield raw[a:].split()


def shingle_bytes(words: list[bytes], n: int) -> Iterator[bytes]:
    """n-word shingles joined by one space."""
    return map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))


def fingerprint(text: str, shingle: int, bits: int, seed: int = 42, repeats: bool = True) -> bytes:
    """The SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes
    (XXH64 with ``seed``; for more than 64 bits, with the next seeds too). A text of fewer
    words than a shingle has the whole sequence as its one shingle; no words: all bits 0."""
    import xxhash

    counts, total = np.zeros(bits, dtype=np.int64), 0
    tail: list[bytes] = []
    few: list[bytes] = []
    met: set[bytes] = set()
    for words in word_runs(text):
        words = tail + words
        few = words if len(words) < shingle else few
        found: Iterator[bytes] | set[bytes] = shingle_bytes(words, shingle)
        if not repeats:
            found = set(found) - met
            met |= found
        found = list(found)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
        for at in range(0, len(found), 100_000):
            run = found[at : at + 100_000]
            got = [np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=seed + s), run)), dtype=np.uint8).reshape(-1, 8) for s in range(bits // 64)]
            counts += np.unpackbits(np.concatenate(got, axis=1), axis=1).sum(axis=0, dtype=np.int64)
            total += len(run)
    if not total:
        if not few:
            return bytes(bits // 8)
        one = b" ".join(few)
        return b"".join(xxhash.xxh64_digest(one, seed=seed + s) for s in range(bits // 64))
    return np.packbits(2 * counts > total).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64, seed: int = 42, repeats: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint string`` (lower-case hex) for each row of ``docs``, computed
    where the row lies. A null text is empty; an empty text's fingerprint is all zeros."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in in_pieces(batch.column(1), RUN):
                got = [fingerprint(t, shingle, bits, seed, repeats).hex() for t in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(got, pa.string())], [id_col, "fingerprint"])
                at += len(part)

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, fingerprint string")


def as_bits(hexes: list[str], bits: int) -> np.ndarray:
    """A row of 0 and 1 for each fingerprint."""
    raw = np.frombuffer(bytes.fromhex("".join(hexes)), dtype=np.uint8)
    return np.unpackbits(raw.reshape(-1, bits // 8), axis=1)


def partitions(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Groups the bits into m partitions of nearly equal size, correlated bits together.
    ``together[i, j]``: in how many of the n fingerprints both bits are set."""
    bits = len(together)
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    strength = np.abs(np.divide(cov, spread, out=np.zeros_like(cov), where=spread > 0))
    np.fill_diagonal(strength, 0)
    free = list(range(bits))
    out = []
    for size in (bits // m + (i < bits % m) for i in range(m)):
        own = [max(free, key=lambda b: (strength[b][free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (strength[b][own].sum(), -b)))
            free.remove(own[-1])
        out.append(own)
    return out


def values(bits: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """The value of each fingerprint in each partition."""
    return [bits[:, g].astype(np.int64) @ (1 << np.arange(len(g), dtype=np.int64)) for g in groups]


def estimates(histogram: np.ndarray, width: int, most: int) -> np.ndarray:
    """Expected candidates at each radius 0..most, for each value of a partition's coarse
    bits: row r has the fingerprints within r bits, those below the coarse ones taken as even."""
    coarse = int(log2(len(histogram)))
    low = width - coarse
    at = np.arange(len(histogram))
    rings = [histogram.astype(float)]
    for d in range(1, min(most, coarse) + 1):  # sums over the values at exactly d bits
        around = sum(rings[-1][at ^ (1 << b)] for b in range(coarse))
        rings.append((around - (coarse - d + 2) * (rings[-2] if d > 1 else 0)) / d)
    ball = [sum(comb(low, d) for d in range(r + 1)) / 2**low for r in range(most + 1)]
    return np.stack([sum(rings[d] * ball[r - d] for d in range(min(r, len(rings) - 1) + 1)) for r in range(most + 1)])


def allocate(costs: list[np.ndarray], total: int) -> np.ndarray:
    """Thresholds of least cost for each fingerprint, one for each partition, -1 or more,
    that sum to ``total``. ``costs[i][r]``: for each fingerprint, the cost of radius r in
    partition i. Dynamic programming over the partitions and the sum so far."""
    m, n = len(costs), costs[0].shape[1]
    most = total + m - 1
    sums = total + m + 1  # thresholds + 1 sum to 0 .. total + m
    best = np.full((sums, n), np.inf)
    best[0] = 0
    choice = np.zeros((m, sums, n), dtype=np.int8)
    for i in range(m):
        after = np.full((sums, n), np.inf)
        for r in range(-1, most + 1):
            cost = costs[i][r] if r >= 0 else 0.0
            for s in range(r + 1, sums):
                c = best[s - r - 1] + cost
                better = c < after[s]
                after[s][better] = c[better]
                choice[i, s][better] = r
        best = after
    out = np.zeros((m, n), dtype=np.int8)
    s = np.full(n, sums - 1)
    for i in reversed(range(m)):
        out[i] = choice[i][s, np.arange(n)]
        s = s - out[i] - 1
    return out


def masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], dtype=np.int64)


def parts_for(n: int, bits: int, k: int) -> int:
    """Partitions for n fingerprints: as many as leave each about log2 n bits, at most k + 1."""
    return max(2 if k > 0 else 1, min(k + 1, int(bits // (log2(max(n, 2)) + 1))))


def links(classes: DataFrame, k: int, bits: int, few: int = FEW) -> DataFrame:
    """``a long, b long``: links between classes (``rep long, fingerprint string``, all
    different) whose fingerprints differ in at most k bits, enough to connect whatever
    all such links connect. ``classes`` is read several times, so give a written table."""
    n = classes.count()
    m = parts_for(n, bits, k)

    def pairs_of_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = np.zeros((bits, bits), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                x = as_bits(batch.column(0).slice(at, 20_000).to_pylist(), bits).astype(np.float32)
                together += np.rint(x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(bits * bits), pa.int32()), pa.array(together.ravel())], ["at", "n"])

    counted = classes.select("fingerprint").mapInArrow(pairs_of_bits, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # bits x bits rows
    together = np.zeros(bits * bits, dtype=np.int64)
    for r in counted:
        together[r["at"]] = r["n"]
    groups = partitions(together.reshape(bits, bits), n, m)
    widths = [len(g) for g in groups]
    coarse = [min(COARSE, w) for w in widths]

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.zeros((m, 1 << COARSE), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                v = values(as_bits(batch.column(0).slice(at, 20_000).to_pylist(), bits), groups)
                for i in range(m):
                    h[i] += np.bincount(v[i] & ((1 << coarse[i]) - 1), minlength=1 << COARSE)
        at = np.flatnonzero(h)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(h.ravel()[at])], ["at", "n"])

    hist = np.zeros(m << COARSE, dtype=np.int64)
    for r in classes.select("fingerprint").mapInArrow(histogram, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # m x 2^COARSE rows at most
        hist[r["at"]] = r["n"]
    total = k - m + 1
    most = min(max(total + m - 1, 0), max(4, -(-total // m)))  # enough for thresholds to sum to `total`
    expected = [estimates(h[: 1 << c], w, most) for h, c, w in zip(hist.reshape(m, -1), coarse, widths, strict=True)]
    probes = [[len(masks(w, r)) if r <= 2 else sum(comb(w, d) for d in range(r + 1)) for r in range(most + 1)] for w in widths]
    words = [f"w{i}" for i in range(bits // 64)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each value probed, and one for each own value (``own``)."""
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                hexes = part.column(1).to_pylist()
                v = values(as_bits(hexes, bits), groups)
                costs = []
                for i in range(m):
                    c = expected[i][:, v[i] & ((1 << coarse[i]) - 1)] + np.array(probes[i])[:, None]
                    costs.append(np.concatenate([c, np.full((max(total + m - 1 - most, 0), c.shape[1]), 1e18)]))
                t = allocate(costs, total)
                raw = np.frombuffer(bytes.fromhex("".join(hexes)), dtype=">i8").reshape(-1, bits // 64).astype(np.int64)
                rep = part.column(0).to_numpy(zero_copy_only=False)
                for i in range(m):
                    for r in (-2, *range(most + 1)):
                        who = np.arange(len(rep)) if r == -2 else np.flatnonzero(t[i] == r)
                        flips = np.zeros(1, dtype=np.int64) if r == -2 else masks(widths[i], r)
                        step = max(1, 100_000 // len(flips))
                        for x in range(0, len(who), step):
                            w = who[x : x + step]
                            key = ((v[i][w][:, None] ^ flips) * 64 + i).ravel()
                            w = np.repeat(w, len(flips))
                            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(w), r == -2)), pa.array(rep[w]), *(pa.array(raw[w, j]) for j in range(bits // 64))], ["key", "own", "rep", *words])

    schema = "key long, own boolean, rep long, " + ", ".join(f"{w} long" for w in words)
    rows = classes.select("rep", "fingerprint").mapInArrow(keyed, schema)
    own, probing = rows.where("own").drop("own"), rows.where("not own").drop("own")
    hot = written(own.groupBy("key").agg(F.count("*").alias("__count")).where(F.col("__count") > few), "hot")
    calm = own.join(hot.select("key"), "key", "left_anti")
    other = calm.select("key", F.col("rep").alias("b"), *(F.col(w).alias(f"{w}b") for w in words))
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}b"))) for w in words), F.lit(0))
    pairs = probing.join(other, "key").where((F.col("rep") != F.col("b")) & (differ <= k)).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()

    def linked(bucket: pd.DataFrame):
        x = bucket[words].to_numpy().view(np.uint64)
        return lambda i, rest: np.bitwise_count(x[rest] ^ x[i]).sum(axis=1) <= k

    # those with a hot value of their own and those that probe it
    near = rows.drop("own").join(hot.select("key"), "key", "left_semi")
    sizes = near.groupBy("key").agg(F.count("*").alias("__count"))
    return pairs.union(bucket_links(near, ["key"], "rep", sizes, linked))


def near_duplicates(docs: DataFrame, k: int = 3, shingle: int = 3, bits: int = 64, seed: int = 42, repeats: bool = True, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """``id_col, fingerprint string, component_id long`` for each row of ``docs``.

    Rows link if their fingerprints differ in at most ``k`` of ``bits`` bits; the
    component is the smallest id reachable by links, the row's own included. A null text
    counts as empty; all texts without words have the zero fingerprint and link like any
    others. Rows without an id link with nothing and have a null component. Equal rows
    give equal rows; an empty table gives an empty one; other columns are left out.
    """
    own = written(fingerprints(docs, shingle, bits, seed, repeats, id_col, text_col), "fingerprints")
    classes = written(own.where(F.col(id_col).isNotNull()).groupBy("fingerprint").agg(F.min(id_col).cast("long").alias("rep")), "classes")
    found = components(links(classes, k, bits, few))
    of = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    joined = own.join(of, "fingerprint", "left")
    return joined.select(id_col, "fingerprint", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))
