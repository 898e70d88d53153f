"""CSV with quoted line breaks, read by many tasks a file.

Spark's own reader gives such a file to one task, since whether a line break ends a record depends
on all quotes before it. Here a file is read as lines, in the splits of Spark's text reader, twice:

1. Each line is told by what it does to the two states that a line may begin in, outside or
   inside quotes: it keeps, swaps or sets them. A split is the composition of its lines, one row;
   a running composition over the splits of a file gives the state that each split begins in.
2. With that, each split finds its records. Those inside a split are complete; of the others a
   split has a beginning, an end or a middle, and only these few move to be put together.

Then each record is parsed on its own by ``from_csv``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: What a line or a split does to the state it begins in, as the states (0 outside, 1 inside
#: quotes) that it ends in after beginning outside and inside: two bits.
KEEP, SWAP, OUTSIDE, INSIDE = 0b10, 0b01, 0b00, 0b11
#: A split's piece of a record that isn't complete in it.
BEGINNING, MIDDLE, END = 0, 1, 2

_SPLIT = pa.schema([("split", pa.int64()), ("at", pa.int64()), ("file", pa.string()), ("does", pa.int32()), ("ends", pa.bool_())])
_PIECE = pa.schema([("file", pa.string()), ("at", pa.int64()), ("first", pa.bool_()), ("piece", pa.int32()), ("record", pa.string())])


#: What a quote does to the three states (0: outside, a quote may begin or be the second of two;
#: 1: outside, inside a field; 2: inside quotes), as the states that it leads to, in base 3: after a
#: quote or a line's start, after a comma, and after anything else.
_AFTER_QUOTE, _AFTER_COMMA, _ELSEWHERE = 2 + 3 * 1 + 9 * 0, 2 + 3 * 2 + 9 * 0, 1 + 3 * 1 + 9 * 0
_LEADS = np.array([[f // 3**s % 3 for s in range(3)] for f in range(27)])
#: One such function after another, and what each does to a line that begins in state 0 or 2.
_THEN = (_LEADS[None, :, :].repeat(27, 0)[np.arange(27)[:, None, None], np.arange(27)[None, :, None], _LEADS[:, None, :]] * 3 ** np.arange(3)).sum(axis=2)
_DOES = ((_LEADS[:, 2] == 2) * 2 + (_LEADS[:, 0] == 2)).astype(np.int32)


def line_effects(lines: pa.Array) -> np.ndarray:
    """What each line does to the states, by the mark before each of its quotes: inside quotes
    a quote ends them, or is the first of two. Outside, it begins them at a field's start (or is
    the second of two); elsewhere it is a mark like others. Quotes of a line are taken together
    two by two, all lines at once."""
    raw = lines.cast(pa.large_binary())
    offsets, values = (np.frombuffer(x, dtype=t) if x is not None else np.zeros(0, t) for x, t in zip(raw.buffers()[1:], (np.int64, np.uint8)))
    offsets = offsets[raw.offset : raw.offset + len(raw) + 1]
    out = np.full(len(raw), KEEP, dtype=np.int32)
    if not len(raw):
        return out
    at = offsets[0] + np.flatnonzero(values[offsets[0] : offsets[-1]] == 0x22)
    line = np.searchsorted(offsets, at, side="right") - 1
    before = np.where(at == offsets[line], 0x22, values[at - 1])
    does = np.where(before == 0x22, _AFTER_QUOTE, np.where(before == 0x2C, _AFTER_COMMA, _ELSEWHERE))
    while True:
        first = np.flatnonzero(np.diff(line, prepend=-1))
        if len(first) == len(line):
            break
        nth = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
        left = np.flatnonzero(nth % 2 == 0)
        paired = left[np.append(nth, 0)[left + 1] % 2 == 1]
        does[paired] = _THEN[does[paired], does[paired + 1]]
        does, line = does[left], line[left]
    out[line] = _DOES[does]
    return out


def _states(effects: np.ndarray, begins: int) -> np.ndarray:
    """The state before each line and after the last."""
    sets = (effects == OUTSIDE) | (effects == INSIDE)
    swaps = np.concatenate([[0], np.cumsum(effects == SWAP)])
    last = np.maximum.accumulate(np.concatenate([[0], np.where(sets, np.arange(1, len(effects) + 1), 0)]))
    base = np.where(last > 0, effects[last - 1] == INSIDE if len(effects) else 0, begins)
    return (base + swaps - swaps[last]) % 2


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(paths)
    place = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
    return rows.select(F.col("value").alias("line"), place.alias("split"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Rows of one split after another."""
    split = batch.column("split").to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(split)) + 1).tolist(), len(split)]
    return zip(edges[:-1], edges[1:])


def split_effects(lines: DataFrame) -> DataFrame:
    """One row for each split: ``split, at, file, does``, and ``ends``: whether a record that is
    open at its beginning ends in it."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for batch in batches:
            done = []
            for a, b in _runs(batch):
                split, at, file = (batch.column(c)[a].as_py() for c in ("split", "at", "file"))
                if now is None or now[0] != split:
                    if now is not None:
                        done.append(now)
                    now = [split, at, file, KEEP, False]
                effects = line_effects(batch.column("line")[a:b])
                out, inside = (_states(effects, s) for s in (now[3] & 1, now[3] >> 1))
                now[3] = int(out[-1]) | int(inside[-1]) << 1
                now[4] = now[4] or bool((inside[1:] == 0).any())
            if done:
                yield _batch(done, _SPLIT)
        if now is not None:
            yield _batch([now], _SPLIT)

    return lines.select("line", "split", "at", "file").mapInArrow(summed, "split long, at long, file string, does int, ends boolean")


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def beginnings(effects: DataFrame) -> DataFrame:
    """``split, inside``: whether a split begins inside quotes, by a running composition over its
    file: what the last split that sets the state set, swapped by each later one that swaps."""
    order = Window.partitionBy("file").orderBy("at")  # a row for each split
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("does") == SWAP).cast("int")).over(before), F.lit(0))
    counted = effects.withColumn("swaps", swaps)
    sets = F.when(F.col("does").isin(OUTSIDE, INSIDE), F.struct("at", (F.col("does") == INSIDE).cast("int").alias("to"), "swaps"))
    last = F.max(sets).over(before)
    state = F.when(last.isNull(), F.col("swaps") % 2).otherwise((last["to"] + F.col("swaps") - last["swaps"]) % 2)
    return counted.select("split", (state == 1).alias("inside"))


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``record``: each record of the files but the first of each, which is a header, as it
    stands, line breaks included; those without a character are left out.

    The splits are gone through once when this is called; nine bytes for each go to all tasks. A
    carriage return at the end of a record isn't part of it."""
    ship(spark)
    lines = _lines(spark, [paths] if isinstance(paths, str) else paths)
    told = beginnings(split_effects(lines)).toArrow().sort_by("split")  # a row for each split
    known = spark.sparkContext.broadcast((told["split"].to_numpy(), told["inside"].to_numpy(zero_copy_only=False)))

    def pieces(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        """The whole records, or the pieces of others."""
        splits, inside = known.value
        now = state = at = file = None
        held: list[str] = []  # lines of a record that goes on
        opened = first = False  # whether it began in an earlier split; whether the header is still to come

        def rest() -> list[tuple]:
            return [(file, at, first, MIDDLE if opened else BEGINNING, "\n".join(held))] if held else []

        for batch in batches:
            out: list[tuple] = []
            for a, b in _runs(batch):
                split = batch.column("split")[a].as_py()
                if split != now:
                    out += rest()
                    i = np.searchsorted(splits, split)
                    if i == len(splits) or splits[i] != split:
                        raise ValueError("the splits of a file changed between its two readings")
                    now, state, opened, held = split, int(inside[i]), bool(inside[i]), []
                    file, at = (batch.column(c)[a].as_py() for c in ("file", "at"))
                    first = at == 0
                lines = batch.column("line")[a:b]
                states = _states(line_effects(lines), state)
                state = int(states[-1])
                ends = np.flatnonzero(states[1:] == 0) + 1  # lines up to the end of each record
                if len(ends):
                    if held or opened or first:  # the first that ends here
                        text = "\n".join(held + lines[: ends[0]].to_pylist())
                        if opened:
                            out.append((file, at, False, END, text))
                        elif first:
                            first = False
                        elif whole:
                            yield _whole(pa.array([text], pa.string()))
                        skip, opened = 1, False
                    else:
                        skip = 0
                    if whole and len(ends) > skip:
                        yield _whole(_joined(lines, np.append(0, ends)[skip:]))
                    held = []
                held += lines[ends[-1] if len(ends) else 0 :].to_pylist()
            if out and not whole:
                yield _batch(out, _PIECE)
        if not whole and (last := rest()):
            yield _batch(last, _PIECE)

    def got(whole: bool) -> DataFrame:
        return lines.select("line", "split", "file", "at").mapInArrow(lambda batches: pieces(batches, whole), "file string, at long, first boolean, piece int, record string")

    # two passes of little work: one read for both would have to lie on disk
    return got(True).select("record").union(_glued(got(False))).select(F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")


def _joined(lines: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Lines from each cut to the next as one text."""
    if len(cuts) - 1 == cuts[-1] - cuts[0]:  # a line each
        return lines[cuts[0] : cuts[-1]]
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), lines), pa.scalar("\n", lines.type))


def _whole(records: pa.Array) -> pa.RecordBatch:
    n = len(records)
    return pa.RecordBatch.from_arrays([*(pa.nulls(n, f.type) for f in list(_PIECE)[:-1]), records.cast(pa.string())], schema=_PIECE)


def _glued(parts: DataFrame) -> DataFrame:
    """Records put together from their pieces: a beginning, and all up to the next one in its
    file. Headers are left out."""
    order = Window.partitionBy("file").orderBy("at", F.desc("piece"))  # in a split the end comes before a beginning
    numbered = parts.withColumn("own", F.sum((F.col("piece") == BEGINNING).cast("int")).over(order))
    whole = numbered.groupBy("file", "own").agg(F.max("first").alias("header"), F.sort_array(F.collect_list(F.struct("at", (-F.col("piece")).alias("order"), "record"))).alias("parts"))
    return whole.where(~F.col("header")).select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))


def read(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows of text columns. Fields that a short record lacks are null, more are left out."""
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    parsed = F.from_csv("record", schema.simpleString()[len("struct<") : -1].replace(":", " "), options)
    return records(spark, paths).select(F.inline(F.array(parsed)))  # a row each; filters that are pushed down would parse once for each column
