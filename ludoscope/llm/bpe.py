"""Byte-level BPE encoding and decoding (operator 10).

A sentencepiece BPE model is serialised straight from a rank file: each token's bytes
are mapped byte by byte to printable characters, its score is its negative rank, and
the normaliser is the identity. Text is split by the tokenizer's pattern; every
pre-token is encoded by itself, and ids are decoded by the inverse of the byte map.
Rows are encoded where they lie: nothing is shuffled.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces

#: Pre-tokens remembered by each Python worker (some 200 bytes each); a full memory is emptied.
CACHE = 500_000
#: Characters that are handled at a time.
RUN = 1_000_000

#: The place before a lone space between two other characters, where a pre-token always begins.
_JOINT = re.compile(r"\S(?= \S)")
_encoders: dict[tuple, "Encoder"] = {}


def byte_characters() -> str:
    """256 printable characters, one for each byte: a byte that is printable in Latin-1
    stands for itself, the others take the characters from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(spare)) for b in range(256))


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol-buffer field: varint, 32-bit float or bytes."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes(out) + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model in which piece i is ``tokens[i]``, scored -i.

    One more piece, the unknown one that the format asks for, follows the last token.
    """
    chars = byte_characters()
    pieces = [_field(1, "".join(map(chars.__getitem__, t)).encode()) + _field(2, -float(i)) + _field(3, 1) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))  # model_type BPE, vocab_size, unk_id
    plain = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no prefix, no squeezing, no escapes
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, plain)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: the ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


class Encoder:
    """Text to ids and back, for one vocabulary and one pattern. The ids of pre-tokens
    are remembered; those that are new in a batch of texts go to the model together,
    each by itself. A pre-token that is a token as a whole has that token's id, by the rule
    of ranks, and needs no model."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.decimal = [str(i) for i in range(len(tokens))]
        self.whole = {t: (i,) for i, t in enumerate(tokens)}
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.chars = byte_characters()
        byte = {c: b for b, c in enumerate(self.chars)}
        self.spelt = [bytes(map(byte.__getitem__, piece)) for piece in self.model.id_to_piece(list(range(len(tokens))))]
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of pre-tokens that aren't remembered; they are from now on."""
        easy, hard, mapped = {}, [], []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if ids := self.whole.get(raw):
                easy[w] = ids
            else:
                hard.append(w)
                mapped.append(raw.decode("latin-1").translate(self.chars))
        if hard:
            easy.update(zip(hard, map(tuple, self.model.encode(mapped, num_threads=1)), strict=True))
        if len(self.known) + len(easy) > CACHE:
            self.known.clear()
        self.known.update(easy)
        return easy

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts, no special tokens."""
        words = [self.pattern.findall(t) for t in texts]
        got = [list(map(self.known.get, w)) for w in words]
        gaps = [(i, k) for i, ids in enumerate(got) if None in ids for k, x in enumerate(ids) if x is None]
        if gaps:
            new = self._learn({words[i][k] for i, k in gaps})
            for i, k in gaps:
                got[i][k] = new[words[i][k]]
        return [list(chain.from_iterable(ids)) for ids in got]

    def encode(self, text: str) -> list[int]:
        """The ids of one text, however long, in pieces of bounded size."""
        ids: list[int] = []
        a = 0
        while len(text) - a > RUN:
            if not (m := _JOINT.search(text, a + RUN)):
                break
            ids += self.encode_batch([text[a : m.start() + 1]])[0]
            a = m.start() + 1
        return ids + self.encode_batch([text[a:]])[0]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for: the model's pieces through the inverse of the byte map."""
        return b"".join(map(self.spelt.__getitem__, ids))


def encoder(tokens: list[bytes], pattern: str, key: tuple) -> Encoder:
    """The encoder of this Python process for ``key``; it outlives a task."""
    if key not in _encoders:
        _encoders[key] = Encoder(tokens, pattern)
    return _encoders[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens long, ids array<int>, decoded binary`` for each row of ``docs``.

    A null text counts as empty and gives no ids; a null id stays null; equal rows give
    equal rows; an empty table gives an empty one; further columns are left out. Texts
    of any length are encoded whole, in runs of pre-tokens.
    """
    return _mapped(docs, path, pattern, id_col, text_col, "n_tokens long, ids array<int>, decoded binary", lambda e, ids: (len(ids), ids, e.decode(ids)))


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode`, with SHA-256 digests in place of the ids and the bytes:
    ``id_col, n_tokens long, ids_sha256 string, decoded_sha256 string``."""

    def digests(e: Encoder, ids: list[int]) -> tuple:
        said = " ".join(map(e.decimal.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()

    return _mapped(docs, path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, columns: str, row) -> DataFrame:
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {columns}"
    out_schema = docs.sparkSession.createDataFrame([], schema).schema
    names = [f.name for f in out_schema]
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # as large as the vocabulary
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    kinds = [types[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and the memory of pre-tokens is slow to walk
        e = encoder(tokens.value, pattern, (path, pattern, len(tokens.value)))
        for batch in batches:
            at = 0
            for part in in_pieces(batch.column(1), RUN):
                ids = [e.encode(part[0])] if len(part) == 1 else e.encode_batch(part)
                got = [row(e, i) for i in ids]
                cols = [pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *cols], names)
                at += len(part)

    return rows.mapInArrow(run, out_schema)
