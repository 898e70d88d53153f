"""Words of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from .common import mix

#: Bytes of text that are taken apart at a time.
RUN = 500_000

_CLASS = np.full(256, 2, dtype=np.uint8)  # 0: white space, 1: letters, digits and bytes beyond ASCII, 2: other marks
_CLASS[list(b"\x00 \t\n\r\x0b\x0c")] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse, for n places at least."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)]).cumprod(dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _powers[size]


def word_bounds(data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of bytes that aren't ``blank`` begin and end."""
    edge = np.flatnonzero(np.diff(blank[data], prepend=True, append=True))
    return edge[::2], edge[1::2]


def hashed(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes of it at a time; those of over 64 bytes by XXH3."""
    import xxhash

    eight = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=raw + bytes(8), strides=(1,))
    size = end - start
    h = mix(size.astype(np.uint64))
    at = np.flatnonzero(size <= 64)
    k = 0
    while len(at):
        have = np.minimum(size[at] - 8 * k, 8).astype(np.uint64)
        part = eight[start[at] + 8 * k] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * have))
        h[at] = mix(h[at] ^ part)
        k += 1
        at = at[size[at] > 8 * k]
    for i in np.flatnonzero(size > 64):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return h


@dataclass
class Words:
    """Runs of letters and digits, and runs of other marks, of a list of texts in order."""

    raw: np.ndarray  #: bytes of all texts, A-Z in lower case
    cased: np.ndarray  #: the same as they are
    start: np.ndarray  #: where each word begins and ends
    end: np.ndarray
    text: np.ndarray  #: the index of its text
    hash: np.ndarray  #: of its bytes in lower case
    letters: np.ndarray  #: whether it is of letters and digits


#: Space that no word is cut at.
_ENDS = b"\x00 \t\n\r\x0b\x0c"


def _pieces(raw: bytes, following: Callable[[bytes], tuple[bytes, int]]) -> Iterator[bytes]:
    """A text's parts of more than RUN bytes, cut at spaces. ``following`` gives, for a part, what
    of it is to be used and where in it the next one begins."""
    a = b = 0
    while (b := raw.find(b" ", max(a + RUN, b + 1))) >= 0:
        used, by = following(raw[a:b])
        yield used
        a += by
    yield raw[a:]


def segments(texts: list[str], again: int = 0) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts as bytes, long ones in parts; the index of the text of each part, and how many of
    its words the part before has too: the last ``again`` of that, or all if they are fewer."""
    out, which, old = [], [], []
    for i, t in enumerate(texts):
        has = [0]

        def following(part: bytes, has: list[int] = has) -> tuple[bytes, int]:
            start = words([part]).start[-again:] if again else ()
            has.append(len(start))
            return part, int(start[0]) if len(start) else len(part)

        for part in _pieces(t.encode().rstrip(_ENDS), following):
            out.append(part)
            which.append(i)
        old += has
    return out, np.array(which, dtype=np.int64), np.array(old, dtype=np.int64)


def windowed(texts: list[str], window: int, step: int) -> tuple[list[bytes], np.ndarray]:
    """Texts as bytes, long ones in parts, and the index of the text of each: windows of
    ``window`` words, one each ``step``, of the parts are those of the whole texts."""

    def following(part: bytes) -> tuple[bytes, int]:
        w = words([part])
        full = (len(w.start) - window) // step + 1 if len(w.start) >= window else 0
        if not full:
            return b"", 0  # more words are needed
        return part[: int(w.end[(full - 1) * step + window - 1])], int(w.start[full * step])

    out, which = [], []
    for i, t in enumerate(texts):
        own = [p for p in _pieces(t.encode().rstrip(_ENDS), following) if p] or [b""]
        out += own
        which += [i] * len(own)
    return out, np.array(which, dtype=np.int64)


def words(texts: list[bytes]) -> Words:
    """The words of texts."""
    cased = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)
    kind = _CLASS[cased]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    at = kind[edge]
    end = np.append(edge[1:], len(cased))
    real = at > 0
    start, end, letters = edge[real], end[real], at[real] == 1
    raw = _LOWER[cased]
    power, inverse = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)])
        hashed = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return Words(raw, cased, start, end, np.searchsorted(bounds, start, side="right"), hashed, letters)
