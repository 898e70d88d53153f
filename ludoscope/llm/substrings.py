"""Removal of repeated word windows by level-wise doubling (operator 5).

The first level looks at windows of half the length, and only at those with the
smallest hash among the ones inside some full window: equal full windows choose the
same. Windows that occur once there are out, and with them every full window that
chose them. What is repeated is extended to twice that length, the full windows around
it, and compared again; :func:`levels` goes on from there, joining surviving windows
with the one that follows them, again twice as long, until no candidates survive. What
a repeated longer window covers, repeated windows of the full length cover too, so the
removal of words stops at that level.
Documents that are equal as a whole are reduced to the first before all this.

Windows are compared by 64-bit hashes of their words at the first level, where a chance
match costs only time, and by 96 bits from then on. Texts are hashed many at a time, in
runs of about a megabyte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_signed, bitmap, in_pieces, mix, thinned, written
from .wording import hashed, word_bounds

#: Characters of text that are hashed at a time.
RUN = 1_000_000
#: Tasks in which the copies of one text are looked up.
SALTS = 16
#: An odd multiplier for each of the two hashes of a window.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(text: str) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+``, unchanged."""
    return text.encode().split()


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in order (``lower``: with A-Z in lower case),
    and the place of each text's first word, with the end last."""
    raw = "\n".join([*texts, ""]).encode()
    start, end = word_bounds(np.frombuffer(raw, dtype=np.uint8), _SPACE)
    length = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), dtype=np.int64, count=len(texts))
    return hashed(raw.lower() if lower else raw, start, end), np.searchsorted(start, np.concatenate([[0], np.cumsum(length + 1)]))


def window_hashes(words: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of each n consecutive words, put together from hashes of 1, 2, 4, ... words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        known, have, power = mix(words ^ base), 1, base  # power: base ** have
        out, done, left = np.zeros(len(words) - n + 1, dtype=np.uint64), 0, n
        while left:
            if left & 1:  # the next `have` words of each window
                out = out * power + known[done : done + len(out)]
                done += have
            left >>= 1
            if left:
                known = known[:-have] * power + known[have:]
                have, power = 2 * have, power * power
    return mix(out)


def _sliding(values: np.ndarray, n: int, best) -> np.ndarray:
    """The ``best`` (np.minimum, np.maximum) of each n consecutive values."""
    have = 1
    while 2 * have <= n:
        values, have = best(values[:-have], values[have:]), 2 * have
    return values if have == n else best(values[: len(values) - (n - have)], values[n - have :])


def anchors(words: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the half windows, the smallest of those inside each full window, and which
    full windows lie in one text. Arrays are empty if no text is so long."""
    n = max(0, len(words) - length + 1)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    half = window_hashes(words, length // 2, BASES[0])
    valid = np.zeros(n, dtype=bool)
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        valid[a : max(a, b - length + 1)] = True
    return half, _sliding(half, length - length // 2 + 1, np.minimum), valid


def chosen(half: np.ndarray, least: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Places of the half windows that are the smallest inside some full window."""
    span = len(half) - len(least) + 1
    # of the full windows around a half window none has a larger smallest hash
    padded = np.concatenate([np.zeros(span - 1, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(span - 1, np.uint64)])
    return np.flatnonzero((_sliding(padded, span, np.maximum) == half) & (half > 0))


def removed(n_words: int, starts: np.ndarray, length: int) -> np.ndarray:
    """True for each word that a window of ``length`` at one of ``starts`` covers."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, the id as ordered here (null last), the text (null: empty), the columns ``keep``
    as k0, k1, ..., and the text's hash, which tells rows of one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"), text.alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    return rows.withColumn("t", F.xxhash64("text"))


def copies(rows: DataFrame) -> DataFrame:
    """``doc, t, only boolean`` of the rows whose whole text a smaller id has too; ``only`` is
    true where the id has no other text."""
    told = rows.select("doc", "t", F.md5(F.col("text").cast("binary")).alias("m"))
    first = told.groupBy("m").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    single = told.groupBy("doc").agg((F.min("m") == F.max("m")).alias("only"))
    # one text may be in a third of all rows, so each meets its copies in SALTS tasks
    spread = first.select("m", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    later = told.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(spread, ["m", "salt"]).where("doc > first")
    return later.select("doc", "t").distinct().join(single, "doc")


def repeated_windows(rows: DataFrame, length: int, but: DataFrame) -> DataFrame:
    """``doc long, t long, start int, a long, b long, again boolean``: the windows of
    ``length`` words that may occur more than once, among them all that do; a, b are the
    window's hashes, ``again`` is true where the same row has the window before. Those that
    only rows of one and the same text have are left out, and so are the rows of the ids
    ``but`` (``doc``)."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in in_pieces(batch.column(2), RUN):
                ids, texts = (batch.column(c).slice(at, len(part)).to_numpy() for c in (0, 1))
                at += len(part)
                words, first = word_hashes(part)
                half, least, valid = anchors(words, first, length)
                if not valid.any():
                    continue
                place = chosen(half, least, valid)
                which = np.searchsorted(first, place, side="right") - 1
                order = np.lexsort((half[place], which))
                which, h = which[order], half[place][order]
                new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (h[1:] != h[:-1])]))
                n = np.minimum(np.diff(np.append(new, len(h))), 2).astype(np.int32)
                cols = [ids[which[new]], texts[which[new]], as_signed(h[new]), n]
                for x in range(0, len(n), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[x : x + 100_000]) for c in cols], ["doc", "t", "h", "n"])

    level = written(rows.select("doc", "t", "text").mapInArrow(halves, "doc long, t long, h long, n int"), "level")
    # in two different texts, or twice in one: what only copies of a text share is no candidate
    often = level.groupBy("h").agg(F.min("t").alias("t"), F.max("t").alias("t2"), F.max("n").alias("n")).where("t < t2 or n > 1").select("h")
    wanted = level.select("doc", "h").join(often, "h", "left_semi").groupBy("doc").agg(F.collect_list("h").alias("hs"))

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in in_pieces(batch.column("text"), RUN):
                own = batch.slice(at, len(part))
                at += len(part)
                words, first = word_hashes(part)
                _, least, valid = anchors(words, first, length)
                hs = np.unique(own.column("hs").flatten().to_numpy().view(np.uint64))
                start = np.flatnonzero(valid)
                h = least[start]
                start = start[hs[np.minimum(np.searchsorted(hs, h), len(hs) - 1)] == h]
                if not len(start):
                    continue
                a, b = (as_signed(window_hashes(words, length, base)[start]) for base in BASES)
                which = np.searchsorted(first, start, side="right") - 1
                order = np.lexsort((start, a, which))
                again = np.zeros(len(start), dtype=bool)
                again[order[1:]] = (which[order[1:]] == which[order[:-1]]) & (a[order[1:]] == a[order[:-1]])
                doc, t = (own.column(c).to_numpy()[which] for c in ("doc", "t"))
                cols = [doc, t, (start - first[which]).astype(np.int32), a, b.astype(np.int32), again]
                for x in range(0, len(start), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[x : x + 100_000]) for c in cols], ["doc", "t", "start", "a", "b", "again"])

    held = written(wanted.join(but, "doc", "left_anti"), "anchors")
    some = thinned(rows.select("doc", "t", "text"), "doc", bitmap(held.select("doc"), "doc"))  # so that few texts move
    return some.join(held, "doc").mapInArrow(wholes, "doc long, t long, start int, a long, b int, again boolean")


def survivors(windows: DataFrame, across: bool = False) -> DataFrame:
    """The windows that occur more than once (``across``: in more than one id), with
    ``first_doc``, the smallest id that has it."""
    seen = windows.groupBy("a", "b").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.count("*").alias("n"))
    return windows.join(seen.where("first_doc < last_doc" if across else "n > 1").drop("n", "last_doc"), ["a", "b"])


def longer(windows: DataFrame, length: int) -> DataFrame:
    """Windows twice as long as ``length``, of two surviving ones that follow each other."""
    after = windows.select("doc", "t", (F.col("start") - length).alias("start"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    both = windows.select("doc", "t", "start", "a", "b").join(after, ["doc", "t", "start"])
    return both.select("doc", "t", "start", F.xxhash64("a", "a2").alias("a"), F.shiftright(F.xxhash64("b", "b2"), 32).cast("int").alias("b"))


def levels(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> Iterator[tuple[int, DataFrame]]:
    """The lengths ``length``, 2 ``length``, ... with their repeated windows (``doc, t, start,
    a, b, first_doc``; t is the text's hash), until no candidates survive. Rows of one and the
    same text count as one: what only they share isn't repeated here."""
    none = docs.sparkSession.createDataFrame([], "doc long")
    now = written(survivors(repeated_windows(_rows(docs, id_col, text_col), length, none).drop("again")), "windows")
    while not now.isEmpty():
        yield length, now
        now = written(survivors(longer(now, length)), "windows")
        length *= 2


def _removed(docs: DataFrame, length: int, id_col: str, text_col: str, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = _rows(docs, id_col, text_col, keep)
    whole = written(copies(rows), "copies")
    windows = repeated_windows(rows, length, whole.where("only").select("doc"))
    windows = written(windows, "windows")
    # most whole copies aren't among the windows: what they repeat, their first has, whose id is smaller
    later = survivors(windows.where("not again"), across=True).where("doc > first_doc").select("doc", "t", "start")
    own = windows.where("again").select("doc", "t", "start")
    covered = later.union(own).groupBy("doc", "t").agg(F.collect_set("start").alias("starts"))
    covered = covered.join(whole, ["doc", "t"], "left_anti").union(whole.select("doc", "t", F.array(F.lit(-1)).alias("starts")))

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, gone, out = [], [], []
                for text, starts in zip(part.column("text"), part.column("starts"), strict=True):
                    words = words_of(text.as_py())
                    n.append(len(words))
                    if starts.is_valid:
                        s = starts.values.to_numpy()
                        if s[0] < 0:
                            words = [] if len(words) >= length else words
                        else:
                            over = removed(len(words), s, length)
                            words = [w for w, x in zip(words, over.tolist(), strict=True) if not x]
                    gone.append(n[-1] - len(words))
                    if column == "kept_sha256":
                        out.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    else:
                        out.append(b" ".join(words).decode() if gone[-1] else text.as_py())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string()), *(part.column(f"k{i}") for i in range(len(keep)))], [id_col, "n_words", "n_removed", column, *keep])

    covered = written(covered, "covered")
    schema = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_words long, n_removed long, {column} string" + "".join(f", `{c}` {rows.schema[f'k{i}'].dataType.simpleString()}" for i, c in enumerate(keep))
    names = ["id", "text", "starts", *(f"k{i}" for i in range(len(keep)))]
    # texts that surely lose nothing stay where they are
    lossy = bitmap(covered.select("doc").distinct(), "doc")
    moved = thinned(rows, "doc", lossy).join(covered, ["doc", "t"], "left").select(names)
    still = thinned(rows, "doc", lossy, inside=False).withColumn("starts", F.lit(None).cast("array<int>")).select(names)
    return moved.union(still).mapInArrow(stay, schema)


def remove_repeats(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, n_words long, n_removed long, kept string, <keep>`` for each row of ``docs``: each
    word goes that a window of ``length`` words covers whose words also start earlier, in a
    row of smaller id or before in the same row. Windows are judged on the input. ``kept``
    holds the words that stay, joined by one space, or the text itself if all do.

    A null text has no words. Rows with a null id come after all others; rows with equal
    ids, or with none, see smaller ids and themselves, but not each other. An empty table
    gives an empty one; other columns are left out.
    """
    return _removed(docs, length, id_col, text_col, "kept", keep)


def remove_repeats_digest(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`remove_repeats`, with the SHA-256 of the kept words, ``kept_sha256 string``."""
    return _removed(docs, length, id_col, text_col, "kept_sha256")
