"""What the operators share: the scratch folder of the cluster, written tables, text helpers."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_path
from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at a time, on both sides of the pipe; by Spark's own
#: limit 64 MB, of which an executor has some for each task, in the JVM and in Python.
BATCH = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on texts go to Python workers BATCH bytes at a time, unless the session has a limit of its own."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, BATCH)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and a lost
    executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def remainder(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % mod


def give_back() -> None:
    """Gives memory that a Python worker has freed back to the system. Workers serve one task
    after another, and what a task held at its peak would add up with the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def in_pieces(column, most: int) -> Iterator[list[str]]:
    """Runs of consecutive texts of an Arrow column, of about ``most`` characters each; a
    single text stays whole, and null is an empty text. Memory is given back at the end."""
    run: list[str] = []
    size = 0
    for t in column:
        run.append(t.as_py() or "")
        size += len(run[-1])
        if size >= most or len(run) >= 2000:
            yield run
            run, size = [], 0
    if run:
        yield run
    del run
    give_back()


def crc_remainder(value, mod: int) -> int:
    """The same as :func:`remainder` for a Python value."""
    return zlib.crc32(str(value).encode()) % mod


#: Bits of a bitmap at least for each of its members, and at most in all (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A map, as bytes, that tells which values aren't in a column of distinct longs: those
    whose bit isn't set. Of others about one in BITS_EACH is let through by chance; beyond
    MOST_BITS / BITS_EACH members more are, and the map, which is as large at most, thins
    out less. So it may only spare work that a join would do, not replace the join."""
    n = ids.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * n - 1).bit_length() if n else 0))
    at = F.shiftrightunsigned(F.xxhash64(column), 64 - (bits.bit_length() - 1))

    def chunk(own: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << 16, dtype=bool)
        on[own["at"].to_numpy() & 0xFFFF] = True
        return pd.DataFrame({"chunk": [int(own["at"].iloc[0] >> 16)], "raw": [np.packbits(on, bitorder="little").tobytes()]})

    got = ids.select(at.alias("at")).groupBy(F.shiftright("at", 16)).applyInPandas(chunk, "chunk int, raw binary").collect()  # MOST_BITS bits at most
    out = np.zeros((bits >> 16, 1 << 13), dtype=np.uint8)
    for r in got:
        out[r["chunk"]] = np.frombuffer(r["raw"], dtype=np.uint8)
    return out.ravel()


def maybe_in(packed: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which values, given by Spark's xxhash64, may be in a :func:`bitmap`."""
    bits = 8 * len(packed)
    at = hashed.view(np.uint64) >> np.uint64(64 - (bits.bit_length() - 1))
    return packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def spark_hash(values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs: XXH64 of eight bytes with seed 42."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def rotated(x: np.ndarray, n: int) -> np.ndarray:
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8)
        h = h ^ rotated(values.view(np.uint64) * p2, 31) * p1
        h = rotated(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return (h ^ h >> np.uint64(32)).view(np.int64)


def thinned(rows: DataFrame, column: str, packed: np.ndarray, inside: bool = True) -> DataFrame:
    """The rows whose value may be in a :func:`bitmap`, or the others, for which it surely
    isn't. Only the hash goes to Python."""
    held = rows.sparkSession.sparkContext.broadcast(packed)  # MOST_BITS at most

    @F.pandas_udf("boolean")
    def on(hashed: pd.Series) -> pd.Series:
        return pd.Series(maybe_in(held.value, hashed.to_numpy()) == inside)

    return rows.where(on(F.xxhash64(column)))


def as_signed(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers as Spark's signed longs."""
    return h.view(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, so that all bits depend on all bits."""
    h = h.copy()
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h
