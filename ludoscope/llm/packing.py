"""Best-fit packing of tokenised documents into sequences of fixed capacity (operator 9).

Documents are tokenised where they lie and cut into pieces of at most the capacity.
What the planner needs of them is only how many pieces have each length, a table no
longer than the capacity whatever the corpus. On it the linear grouping scheme runs:
large lengths are sorted and cut into groups of equal cardinality, each rounded up to
its longest; fractional configurations of the few rounded lengths are optimised by
column generation and rounded down; actual lengths take the places of the rounded
ones, in a sequence's last place the longest that fits; what is left over, and all small
lengths, go best-fit into the space that remains. The plan is a list of runs "the pieces ranked a to b among those of length s
go to these places"; ranks are counted in parallel, so no task sees all pieces.
"""

from __future__ import annotations

import bisect
import gc
import hashlib
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import give_back, in_pieces, written

#: Chunks remembered by each Python worker (some 200 bytes each) before they count as old;
#: old ones that aren't met again until as many new ones are known are forgotten.
CACHE = 150_000
#: Bytes of text that are tokenised at a time.
RUN = 1_000_000
#: A gap of fewer tokens is left to be filled as a whole, since few documents are so short.
SPARE = 128
#: A byte that UTF-8 never has, for the end of a word.
END = b"\xff"
#: Groups of the large lengths.
GROUPS = 32
#: Shares of the capacity above which a length may count as large; of the plans for each,
#: the one with the fewest sequences is taken.
LARGE = (1 / 4, 1 / 3, 1 / 2)

_tokenizers: dict[str, "Chunks"] = {}


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """The tokens of a byte-mapped vocabulary as bytes, those that end a word with END after
    them. Merging the pair of lowest rank first by these is what the list of merges does if
    every token has one pair that makes it, as a test holds for the given vocabulary."""
    back = {c: b for b, c in enumerate(chr(b).translate(byte_characters()) for b in range(256))}
    out = {bytes(back[c] for c in t.removesuffix("</w>")) + END * t.endswith("</w>"): i for t, i in vocabulary.items()}
    return out | {END: len(vocabulary)}


class Chunks:
    """Ids of texts by a tokenizer that drops white space, as little-endian uint32 bytes.

    White space always ends a word here, so text is cut there and the ids of the
    chunks are remembered. Lower case being the tokenizer's own first step, A-Z are
    lowered before, unless a combining mark might join the letter. New chunks of plain
    Latin text, which no normal form changes, are split into words by the tokenizer's
    own pattern, its classes spelt out, and merged word by word; all others take the
    whole tokenizer.
    """

    def __init__(self, definition: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core already
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition)
        told = json.loads(definition)
        split = next((p["pattern"]["Regex"] for p in (told.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]), None)
        self.words = None
        if split and told["model"].get("end_of_word_suffix") == "</w>":
            kinds = {k: re.escape("".join(c for c in map(chr, range(0x21, 0x250)) if unicodedata.category(c)[0] == k)) for k in "LN"}
            for k, own in kinds.items():
                split = split.replace(f"[\\p{{{k}}}]", f"[{own}]").replace(f"\\p{{{k}}}", own)
            if "\\p" not in split:
                self.words = re.compile(split).findall
        self.merged = tiktoken.Encoding("merges", pat_str=".+", mergeable_ranks=byte_ranks(told["model"]["vocab"]), special_tokens={})._core_bpe.encode_single_piece if self.words else None
        self.plain = re.compile("[!-~\u00a1-\u024f]+")
        self.marks = regex.compile(r"\p{M}")
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks that aren't remembered; they are from now on."""
        new, odd = {}, []
        words, merged = self.words, self.merged
        for c in chunks:
            t = c.decode()
            if words and b"<|" not in c and (t.isprintable() if t.isascii() else self.plain.fullmatch(t)):
                ids: list[int] = []
                for w in words(t.lower()):
                    ids += merged(w.encode() + END)
                new[c] = array("I", ids).tobytes()
            else:
                odd.append(c)
        got = self.model.encode_batch([c.decode() for c in odd], add_special_tokens=False)
        new |= {c: array("I", e.ids).tobytes() for c, e in zip(odd, got, strict=True)}
        if len(self.known) + len(new) > CACHE:
            self.old, self.known = self.known, {}
        self.known.update(new)
        return new

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = []
        for t in texts:
            raw = t.encode()
            special = b"<|" in raw  # the tokenizer finds special tokens before it lowers case
            cut.append((raw if special or (len(raw) != len(t) and self.marks.search(t)) else raw.lower()).split())
        here = dict.fromkeys(chain.from_iterable(cut))  # of this run only, so that looking up is fast
        fresh = []
        known, old = self.known, self.old
        for c in here:
            x = known.get(c)
            if x is None:
                x = old.get(c)
                if x is None:
                    fresh.append(c)
                else:
                    known[c] = x
            here[c] = x
        if fresh:
            here |= self._learn(fresh)
        return [b"".join(map(here.__getitem__, c)) for c in cut]

    def long_ids(self, text: str) -> bytes:
        """The ids of one text, however long, in pieces of bounded size."""
        out, a = [], 0
        while len(text) - a > RUN and (b := text.find(" ", a + RUN)) >= 0:
            out += self.ids([text[a:b]])
            a = b
        return b"".join(out + self.ids([text[a:]]))


def _chunks(definition: str) -> Chunks:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _tokenizers:
        _tokenizers[key] = Chunks(definition)
    return _tokenizers[key]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece int, start long, length long, ids_crc32 long``: each document's ids
    and ``end_id`` after them, cut after every ``capacity`` ids. A null text is empty."""
    with open(path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # as large as the vocabulary
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and the memory of chunks is slow to walk
        chunks = _chunks(definition.value)
        for batch in batches:
            at = 0
            for part in in_pieces(batch.column(1), RUN):
                ids = [chunks.long_ids(part[0])] if len(part) == 1 else chunks.ids(part)
                out = []
                for k, raw in enumerate(ids):
                    raw += end
                    for n, a in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[a : a + 4 * capacity]
                        out.append((at + k, n, a // 4, len(own) // 4, zlib.crc32(own)))
                at += len(part)
                which, n, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], [id_col, "piece", "start", "length", "ids_crc32"])
        chunks.known, chunks.old = {}, {}  # other tasks of this worker need the memory
        gc.enable()  # and make cycles
        give_back()

    return rows.mapInArrow(run, schema)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of the given lengths and how often to use each, by column generation: the
    fractional optimum of covering ``demand``, rounded down. Deterministic."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, dtype=float)
    for _ in range(60 * m):
        inverse = np.linalg.inv(basis)
        price = np.ones(m) @ inverse
        pattern, worth = _best_pattern(sizes, price, capacity)
        if worth <= 1 + 1e-7:
            break
        x, way = inverse @ need, inverse @ pattern
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = pattern
    x = np.linalg.solve(basis, need)
    return [([int(c) for c in basis[:, j]], int(np.floor(x[j] + 1e-6))) for j in range(m) if x[j] >= 1 - 1e-6]


def _best_pattern(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The pattern of highest price that fits, by dynamic programming over the space used."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for j, s in enumerate(sizes):
        if price[j] <= 1e-12:
            continue
        for _ in range(capacity // s):  # one more of this length each time
            more = best[:-s] + price[j]
            better = more > best[s:] + 1e-12
            if not better.any():
                break
            # a pattern is read back through `last`, so only whole rounds are taken over
            best[s:] = np.where(better, more, best[s:])
            last[s:] = np.where(better, j, last[s:])
    out, at = np.zeros(len(sizes)), int(np.argmax(best))
    worth = 0.0
    while at > 0 and last[at] >= 0 and sizes[last[at]] <= at:
        out[last[at]] += 1
        worth += price[last[at]]
        at -= sizes[last[at]]
    return out, worth


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> tuple[np.ndarray, int]:
    """The best plan of :func:`plan_for` over the thresholds ``large``."""
    return min((plan_for(counts, capacity, groups, x) for x in large), key=lambda p: p[1])


def plan_for(counts: dict[int, int], capacity: int, groups: int, large: float) -> tuple[np.ndarray, int]:
    """Places for ``counts[length]`` pieces of each length.

    Returns rows ``length, first rank, pieces, first sequence, offset, pieces per
    sequence`` and the number of sequences. Both depend on the counts of lengths only;
    work and rows are bounded by the capacity, not by the number of pieces.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("a piece is longer than a sequence, or empty")
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    space: dict[int, list[tuple[int, int]]] = {}  # space left in a sequence: (first sequence, sequences)
    spaces: list[int] = []
    sequences = 0

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in space:
                bisect.insort(spaces, room)
                space[room] = []
            space[room].append((first, n))

    def place(s: int, n: int, first: int, room: int, each: int) -> None:
        rows.append((s, used[s], n, first, capacity - room, each))
        used[s] += n
        left[s] -= n

    # groups of equal cardinality among the large lengths, longest first
    big = sorted((s for s in left if s > large * capacity), reverse=True)
    per = -(-sum(left[s] for s in big) // groups) if big else 0
    rounded: list[int] = []
    members: list[int] = []  # pieces of a group
    room_in_group = 0
    for s in big:
        n = left[s]
        while n:
            if not room_in_group:
                rounded.append(s)
                members.append(0)
                room_in_group = per
            t = min(n, room_in_group)
            members[-1] += t
            n -= t
            room_in_group -= t
    demand: dict[int, int] = {}
    for s, own in zip(rounded, members, strict=True):
        demand[s] = demand.get(s, 0) + own
    sizes = list(demand)
    large_left = sorted(big)

    def longest(limit: int) -> int | None:
        """The longest large piece left of at most ``limit``."""
        k = bisect.bisect_right(large_left, limit)
        while k and not left[large_left[k - 1]]:
            k -= 1
            del large_left[k]
        return large_left[k - 1] if k else None

    # actual pieces take the places: the longest left that the rounded length allows, and in a
    # sequence's last place the longest left that fits, so that little of it stays empty
    for pattern, times in configurations(sizes, [demand[s] for s in sizes], capacity):
        runs = [(sequences, times, capacity)]
        slots = [s for s, c in sorted(zip(sizes, pattern, strict=True), reverse=True) for _ in range(c)]
        for k, size in enumerate(slots):
            after = []
            for first, n, room in runs:
                last = k == len(slots) - 1 and k > 0
                while n and (s := longest(room if last else size)) and not (last and 0 < room - s < SPARE):
                    t = min(n, left[s])
                    place(s, t, first, room, 1)
                    after.append((first, t, room - s))
                    first, n = first + t, n - t
                if n and k:
                    after.append((first, n, room))
            runs = after
        sequences += sum(n for _, n, _ in runs)
        for first, n, room in runs:
            keep(room, first, n)
    # the rest and the small, longest first, each into the fullest sequence that takes it
    for s in sorted(left, reverse=True):
        while n := left[s]:
            k = bisect.bisect_left(spaces, s)
            if k == len(spaces):
                each = capacity // s
                keep(capacity, sequences, -(-n // each))
                sequences += -(-n // each)
                continue
            room = spaces[k]
            first, there = space[room].pop()
            if not space[room]:
                del space[room]
                spaces.pop(k)
            each = room // s
            full = min(there, n // each)
            if full:
                place(s, full * each, first, room, each)
                keep(room - each * s, first, full)
                first, there = first + full, there - full
            if there:
                if rest := min(left[s], each - 1) if left[s] < each else 0:
                    place(s, rest, first, room, rest)
                    keep(room - rest * s, first, 1)
                    first, there = first + 1, there - 1
                keep(room, first, there)
    out = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    return out, sequences


def pack(cut: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id long, offset long`` to pieces as made by :func:`pieces`.

    ``cut`` is read several times, so give a written table. Pieces are ranked among
    those of their length by the hash of their key, then by the key, the start and the ids;
    repeated rows are alike in all of these and take places of their own. A null id is a key like others. An
    empty table gives an empty one.
    """
    counted = cut.groupBy("length").count().collect()  # at most `capacity` rows
    rows, _ = plan({r["length"]: r["count"] for r in counted}, capacity)
    total = sum(r["count"] for r in counted)
    # salted, since one length may have a large share of all pieces
    salts = max(16, -(-total // 100_000))
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "__salt").count().select("length", "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("length", "__salt").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = salted.withColumn("__n", F.row_number().over(own)).join(starts, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__n") - 1).drop("__salt", "__before", "__n")
    places = cut.sparkSession.sparkContext.broadcast(rows)  # its rows are bounded by the capacity
    names = [c for c in cut.columns]
    schema = cut.select(names).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        keys = p[:, 0] << 48 | p[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            own = p[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            k = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(own[:, 3] + k // own[:, 5]), pa.array(own[:, 4] + k % own[:, 5] * length)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises and packs: :func:`pieces`, written to the shared folder, then :func:`pack`."""
    return pack(written(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity, id_col)
