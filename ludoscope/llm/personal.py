"""Personal data by rules and a skip-chain conditional random field.

Rules find emails, addresses, cards and phones in plain forms. A field over a document's tokens
then adds mentions in other forms: a number without its country, an address with dashes, the
local part of an email. Tokens are words that hold a digit or an ``@``, and words that equal an
email's local part; all others are known to be none. Neighbouring tokens share a potential, and
so do distant ones that repeat each other (equal by digits or letters) or are similar (the
last seven digits, the local part). As all pairs of a hundred repeats would be thousands, each
group of equal or similar tokens shares a hub, a variable for what the repeats are. Tokens that a
rule covers are held at its kind, and so is their hub; loopy sum-product over the tokens and hubs carries that to the
mentions, and a token whose most likely label is a kind becomes a span.

The weights are learnt by pseudo-likelihood in one task from at most :data:`SAMPLE` documents:
their tokens that no rule covers and that repeat nothing are none, and mentions in other forms
are made of what rules found, once beside it (its kind) and once alone (none).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, written

#: Fixed by the contract: the kinds in order, their patterns and bounds.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPACE = " \t\n\x0b\x0c\r"

#: Documents learnt from at most, and tokens of each at most (those of more aren't learnt from).
SAMPLE, TOKENS = 4096, 256
#: Rounds of messages: labels travel so many links at most.
ROUNDS = 40
LABELS = 1 + len(KINDS)  # 0 is none
_NOT = -60.0

_HIT, _BLANK, _WORD = re.compile("[0-9@]"), re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]+")
_OCTETS = re.compile(r"[0-9]{1,3}(?:[^0-9A-Za-z][0-9]{1,3}){3}\Z")
_CORE = re.compile(r"[^\W_]|[+(]")
_MANY = (3, 5, 7, 9, 13, 16, 20)  # borders of the numbers of digits that are told apart
#: Inputs of a token: constant, @, +, bracket, letters, four small numbers, sum check, hyphen, dot, and how many digits.
INPUTS = 8 + 1 + len(_MANY) + 1

Span = tuple[int, int, int]


# -- rules ---------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            after = found.end()
            yield start, after
        at = text.find("@", max(after, at + 1))


def by_rules(text: str) -> list[Span]:
    """``kind, start, end`` of all that the rules find, by kind, then start. Each kind takes
    time in proportion to the text: no run is gone through twice."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _HIT.search(text):
        out += [(1, *m.span()) for m in ADDRESS.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := _only_digits(m.group())) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_only_digits(m.group())) <= 15]
    return out


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# -- tokens --------------------------------------------------------------------------------


def _words(text: str, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """Words with a digit or an ``@``, and those that equal an email's local part."""
    names = {text[a : text.index("@", a)].lower() for k, a, _ in spans if k == 0}
    names = {n for n in names if _tells(n) and not _HIT.search(n)}
    if names:
        for m in _WORD.finditer(text):
            if _HIT.search(m.group()) or m.group().strip(".,;:!?()[]<>\"'").lower() in names:
                yield m.span()
        return
    end = 0
    while (hit := _HIT.search(text, end)) is not None:
        start = max(text.rfind(c, end, hit.start()) for c in SPACE) + 1 or end
        stop = _BLANK.search(text, hit.start())
        yield start, (end := stop.start() if stop else len(text))


def _tells(name: str) -> bool:
    """Whether a local part is more than a short or plain word."""
    return len(name) >= 5 and not name.isalpha() and any(c.isalpha() for c in name)


def _key(kind: str, value: str) -> int:
    """A number that isn't 0."""
    return int.from_bytes(hashlib.blake2b(f"{kind}{value}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


@dataclass
class Tokens:
    """The tokens of a document in order."""

    start: list[int]
    end: list[int]
    inputs: list[int]  #: a bit for each input
    held: list[int]  #: 1 more than the kind that a rule covers it with, or 0
    joined: list[bool]  #: whether only blanks lie between the token and the one before
    equal: list[int]  #: tokens with the same number repeat each other; 0: nothing to tell
    similar: list[int]


def _seen(core: str) -> tuple[int, int, int]:
    """Inputs and the two keys of a token."""
    digits = _only_digits(core)
    letters = any(c.isalpha() for c in core)
    octets = _OCTETS.match(core.strip("()+")) is not None
    many = sum(len(digits) >= m for m in _MANY)
    facts = (True, "@" in core, "+" in core, "(" in core, letters, octets and all(int(p) <= 255 for p in re.findall("[0-9]+", core)), 16 <= len(digits) <= 19 and luhn(digits), "-" in core, "." in core)
    bits = sum(1 << i for i, f in enumerate(facts) if f) | 1 << len(facts) + many
    if letters:
        name = re.split(r"@|[\[(]at[\])]", core.lower())[0]
        return bits, _key("e", core.lower()), _key("l", name) if _tells(name) else 0
    equal = _key("i", ".".join(re.findall("[0-9]+", core))) if octets else _key("d", digits) if len(digits) >= 7 else 0
    return bits, equal, _key("s", digits[-7:]) if len(digits) >= 7 else 0


def tokens(text: str, spans: list[Span]) -> Tokens:
    """A document's tokens, without the marks around them."""
    got = Tokens([], [], [], [], [], [], [])
    order = sorted(spans, key=lambda s: (s[1], s[2]))
    at, reach, last = 0, [], 0
    for a, b in _words(text, spans):
        while at < len(order) and order[at][1] < b:
            reach.append(order[at])
            at += 1
        reach = [s for s in reach if s[2] > a]
        first = _CORE.search(text, a, b)
        if first is None:
            continue
        start, end = first.start(), b
        while end > start + 1 and not (text[end - 1].isalnum() or (text[end - 1] == ")" and "(" in text[start:end])):
            end -= 1
        bits, equal, similar = _seen(text[start:end])
        got.start.append(start)
        got.end.append(end)
        got.inputs.append(bits)
        got.held.append(1 + min((s[0] for s in reach), default=-1))
        got.joined.append(bool(got.start) and last > 0 and not text[last:a].strip(SPACE))
        got.equal.append(equal)
        got.similar.append(similar)
        last = b
    return got


# -- the field -----------------------------------------------------------------------------


@dataclass
class Weights:
    """Logarithms of potentials."""

    inputs: np.ndarray  #: input, label
    next: np.ndarray  #: label, label of the token after
    equal: np.ndarray  #: what the hub is, label
    similar: np.ndarray

    def packed(self) -> bytes:
        return np.concatenate([x.ravel() for x in (self.inputs, self.next, self.equal, self.similar)]).astype("<f8").tobytes()

    @staticmethod
    def unpacked(raw: bytes) -> Weights:
        flat, side = np.frombuffer(raw, "<f8"), LABELS * LABELS
        a, b, c, d = np.split(flat, np.cumsum([INPUTS * LABELS, side, side]))
        return Weights(a.reshape(INPUTS, LABELS), *(x.reshape(LABELS, LABELS) for x in (b, c, d)))

    @staticmethod
    def none() -> Weights:
        return Weights(np.zeros((INPUTS, LABELS)), *(np.zeros((LABELS, LABELS)) for _ in range(3)))


@dataclass
class Field:
    """Tokens of many documents as arrays; a document's keys are made its own."""

    inputs: np.ndarray
    held: np.ndarray
    joined: np.ndarray
    equal: np.ndarray  #: the token's hub, -1 for none
    similar: np.ndarray

    @staticmethod
    def of(doc: np.ndarray, inputs: np.ndarray, held: np.ndarray, joined: np.ndarray, equal: np.ndarray, similar: np.ndarray) -> Field:
        bits = (inputs[:, None] >> np.arange(INPUTS) & 1).astype(float)
        joined = joined & (np.diff(doc, prepend=-1) == 0)
        return Field(bits, held, joined, _hubs(doc, equal), _hubs(doc, similar))


def _hubs(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number for each key that at least two tokens of a document have; -1 for the others."""
    out = np.full(len(doc), -1)
    at = np.flatnonzero(key)
    if len(at):
        _, which, n = np.unique(np.stack([doc[at], key[at]]), axis=1, return_inverse=True, return_counts=True)
        shared = n[which] > 1
        out[at[shared]] = np.unique(which[shared], return_inverse=True)[1]
    return out


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def beliefs(field: Field, w: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Each token's chances of the labels, by sum-product messages between all linked
    variables at once, half of each taken from the round before."""
    n = len(field.held)
    right = np.flatnonzero(field.joined)  # links are (right - 1, right)
    own = field.inputs @ w.inputs
    alone = np.ones(n, dtype=bool)
    alone[right] = False
    own[alone] += w.next[0]  # what lies before is none
    alone = np.ones(n, dtype=bool)
    alone[right - 1] = False
    own[alone] += w.next[:, 0]
    sure = field.held > 0
    own[sure] = _NOT
    own[sure, field.held[sure]] = 0.0

    # variables: tokens, then hubs of both sorts; links by their ends and the potential between them
    e, s = np.flatnonzero(field.equal >= 0), np.flatnonzero(field.similar >= 0)
    hubs = int(field.equal.max(initial=-1)) + 1
    more = int(field.similar.max(initial=-1)) + 1
    a = np.concatenate([right - 1, n + field.equal[e], n + hubs + field.similar[s]])
    b = np.concatenate([right, e, s])
    sort = np.repeat([0, 1, 2], [len(right), len(e), len(s)])
    told = np.full(hubs + more, LABELS)  # a hub with a token that a rule covers is of that kind
    for at, of in ((e, field.equal[e]), (s, hubs + field.similar[s])):
        np.minimum.at(told, of, np.where(field.held[at] > 0, field.held[at], LABELS))
    entity = np.zeros((hubs + more, LABELS))
    known = told < LABELS
    entity[known] = _NOT
    entity[known, told[known]] = 0.0
    own = np.concatenate([own, entity])
    if not len(a):
        return np.exp(own - _soft(own, 1)[:, None])
    between = np.stack([w.next, w.equal, w.similar])[sort]
    to_b, to_a = np.zeros((len(a), LABELS)), np.zeros((len(a), LABELS))

    def all_in() -> np.ndarray:
        total = own.copy()
        for y in range(LABELS):
            total[:, y] += np.bincount(b, to_b[:, y], len(own)) + np.bincount(a, to_a[:, y], len(own))
        return total

    for _ in range(rounds):
        total = all_in()
        new_b = _soft((total[a] - to_a)[:, :, None] + between, 1)
        new_a = _soft((total[b] - to_b)[:, None, :] + between, 2)
        to_b = (to_b + new_b - new_b.max(axis=1, keepdims=True)) / 2
        to_a = (to_a + new_a - new_a.max(axis=1, keepdims=True)) / 2
    total = all_in()[:n]
    return np.exp(total - _soft(total, 1)[:, None])


# -- learning ------------------------------------------------------------------------------


def other_forms(kind: int, found: str, rng: random.Random) -> str:
    """What a rule found, as no rule would find it."""
    digits = _only_digits(found)
    if kind == 0:
        name, host = found.split("@")
        return rng.choice([name, f"{name}[at]{host}", f"{name}(at){host}"])
    if kind == 1:
        return rng.choice("-_:/").join(re.findall("[0-9]+", found))
    if kind == 2:
        mark = rng.choice("./_")
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = digits[-10:] if len(digits) > 9 else digits
    area, middle, last = tail[:-7], tail[-7:-4], tail[-4:]
    return rng.choice([f"({area}) {middle}-{last}", f"{area}-{middle}-{last}", f"{area}.{middle}.{last}", f"0{tail}", f"{area} {middle}-{last}"])


def _stranger(found: str, rng: random.Random) -> str:
    """Something of the same shape."""
    return "".join(rng.choice("0123456789") if c.isdigit() else rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in found)


def _made(kind: int, found: str, rng: random.Random) -> Iterator[tuple[Tokens, list[int]]]:
    """A mention in another form beside what it repeats, alone, and as a stranger next to
    what it doesn't repeat, with their labels."""
    form, first, second = other_forms(kind, found, rng), *(other_forms(kind, _stranger(found, rng), rng) for _ in range(2))
    for text, label in ((f"{found} x {form} x", kind + 1), (f"x {form} x", 0), (f"{first} {found} {second}", 0)):
        spans = by_rules(text)
        t = tokens(text, spans)
        yield t, [h or label for h in t.held]


def learn(docs: list[Tokens], found: list[tuple[int, str]], steps: int = 400, seed: int = 7) -> Weights:
    """Weights of the largest pseudo-likelihood, less a small square. Links have weights for
    ends that differ only: were there one for ends that agree, tokens that repeat each other
    would make a kind of themselves that none of them is alone."""
    rng = random.Random(seed)
    parts: list[tuple[Tokens, list[int], list[bool]]] = []
    for t in docs:
        sure = {k for k, h in zip((*t.equal, *t.similar), (*t.held, *t.held)) if h and k}
        free = [not h and e not in sure and s not in sure for h, e, s in zip(t.held, t.equal, t.similar)]
        parts.append((t, list(t.held), free))
    for kind, text in found:
        parts += [(t, labels, [not h for h in t.held]) for t, labels in _made(kind, text, rng)]
    parts = [p for p in parts if p[0].start]
    if not found or not parts:
        return Weights.none()
    doc = np.repeat(np.arange(len(parts)), [len(p[0].start) for p in parts])

    def column(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.array(getattr(p[0], name), dtype=kind) for p in parts])

    f = Field.of(doc, *(column(n, k) for n, k in (("inputs", np.int64), ("held", np.int64), ("joined", bool), ("equal", np.int64), ("similar", np.int64))))
    y = np.concatenate([np.array(p[1]) for p in parts])
    free = np.flatnonzero(np.concatenate([np.array(p[2], dtype=bool) for p in parts]))
    left = np.where(f.joined, np.roll(y, 1), 0)
    right = np.where(np.append(f.joined[1:], False), np.roll(y, -1), 0)

    def of_hub(hub: np.ndarray) -> np.ndarray:
        """What the others of a token's hub are: a kind if one of them is, -1 without a hub."""
        out = np.full(len(hub), -1)
        at = np.flatnonzero(hub >= 0)
        kinds = np.zeros((hub.max(initial=-1) + 1, LABELS), dtype=np.int64)
        np.add.at(kinds, (hub[at], y[at]), 1)
        others = kinds[hub[at]]
        others[np.arange(len(at)), y[at]] -= 1
        out[at] = np.where(others[:, 1:].any(axis=1), others[:, 1:].argmax(axis=1) + 1, 0)
        return out

    he, hs = of_hub(f.equal), of_hub(f.similar)
    x = np.zeros((len(free), INPUTS + 4 * LABELS))
    x[:, :INPUTS] = f.inputs[free]
    for k, given in enumerate((left, right, he, hs)):
        at = np.flatnonzero(given[free] >= 0)
        x[at, INPUTS + k * LABELS + given[free][at]] = 1
    real = np.eye(LABELS)[y[free]]
    w, speed, size = np.zeros((x.shape[1], LABELS)), 0.0, 0.0
    for step in range(1, steps + 1):
        logits = x @ w
        slope = x.T @ (np.exp(logits - _soft(logits, 1)[:, None]) - real) / len(free) + 1e-4 * w
        before, after, equal, similar = (slice(INPUTS + k * LABELS, INPUTS + (k + 1) * LABELS) for k in range(4))
        both = slope[before] + slope[after].T  # one potential, whichever end is asked
        slope[before], slope[after] = both, both.T
        slope[equal], slope[similar] = slope[equal] + slope[equal].T, slope[similar] + slope[similar].T
        for part in (before, after, equal, similar):
            np.fill_diagonal(slope[part], 0)
        speed, size = 0.9 * speed + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        w -= 0.2 * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-8)
    a, b, _, d, e = np.split(w, np.cumsum([INPUTS, LABELS, LABELS, LABELS]))
    return Weights(a, b, d, e)


# -- documents -----------------------------------------------------------------------------

_LISTS = ("start", "end", "inputs", "held", "joined", "equal", "similar")
_TOKENS = ", ".join(f"`{c}` array<{'boolean' if c == 'joined' else 'long'}>" for c in _LISTS)
_FOUND = f"row_id long, kinds array<long>, starts array<long>, ends array<long>, texts array<string>, {_TOKENS}"
_KINDS = {c: pa.list_(pa.bool_() if c == "joined" else pa.int64()) for c in _LISTS}
_FOUND_ARROW = pa.schema([("row_id", pa.int64()), ("kinds", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), *_KINDS.items()])
_RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Spans of the rules and tokens of each row; texts don't go on."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for lo in range(0, batch.num_rows, 1000):
                out = []
                for doc_id, text in zip(ids[lo : lo + 1000], texts[lo : lo + 1000]):
                    text = text.as_py() or ""
                    spans = by_rules(text)
                    t = tokens(text, spans)
                    kinds, starts, ends = zip(*spans) if spans else ((), (), ())
                    out.append((doc_id.as_py(), kinds, starts, ends, [text[a:b] for _, a, b in spans], *(getattr(t, c) for c in _LISTS)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND_ARROW)], schema=_FOUND_ARROW)
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(look, _FOUND)


def _learnt(found: DataFrame, sample: int) -> Weights:
    """Weights from the ``sample`` rows of smallest hash that have tokens."""
    few = found.where(F.size("start").between(1, TOKENS)).withColumn("h", F.xxhash64("row_id", "start"))
    chosen = few.orderBy("h", "row_id").limit(sample).select(F.lit(0).alias("all"), "kinds", "texts", *_LISTS)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        docs = [Tokens(*(list(map(int, r[c])) for c in _LISTS)) for r in rows.to_dict("records")]
        seen = [(int(k), t) for ks, ts in zip(rows["kinds"], rows["texts"]) for k, t in zip(ks, ts)]
        return pd.DataFrame({"raw": [learn(docs, sorted(set(seen))[:sample]).packed()]})

    got = chosen.groupBy("all").applyInPandas(fit, "raw binary").first()  # sample rows of TOKENS tokens at most
    return Weights.none() if got is None else Weights.unpacked(bytes(got["raw"]))


def _added(start: np.ndarray, end: np.ndarray, joined: np.ndarray, held: np.ndarray, label: np.ndarray) -> list[Span]:
    """Spans of tokens that no rule covers; neighbours of one kind are one span."""
    out: list[Span] = []
    for i in np.flatnonzero((held == 0) & (label > 0)):
        kind = int(label[i]) - 1
        if joined[i] and i and held[i - 1] == 0 and label[i - 1] == label[i]:
            out[-1] = (kind, out[-1][1], int(end[i]))
        else:
            out.append((kind, int(start[i]), int(end[i])))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Personal data in each row's whole text.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone`` (what the rules find), ``base_sha256`` (of
    its ``kind:start:end``, by kind, then start, joined by commas) and ``spans``: those and the
    ones that the field adds, in the same order. Places are code points, ends exclusive.

    A null text is empty: no spans. Texts may be of any length; each is read once. Repeated
    rows and null ids give a row each; other columns are left alone; an empty table gives no
    rows. Without anything found by rules in the sample nothing is added.
    """
    found = written(_found(docs, id_col, text_col), "personal")
    weights = _learnt(found, sample).packed()

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Weights.unpacked(weights)
        for batch in batches:
            sizes = batch["start"].map(len).to_numpy()
            label = np.zeros(sizes.sum(), dtype=np.int64)
            flat = {c: np.concatenate([np.asarray(x) for x in batch[c]]) if sizes.sum() else np.zeros(0, np.int64) for c in _LISTS}
            flat = {c: x.astype(bool if c == "joined" else np.int64) for c, x in flat.items()}
            if len(label):
                doc = np.repeat(np.arange(len(batch)), sizes)
                label = beliefs(Field.of(doc, *(flat[c] for c in _LISTS[2:])), w).argmax(axis=1)[: len(label)]
            ends = np.cumsum(sizes)
            out = []
            for i, (doc_id, ks, ss, es) in enumerate(zip(batch["row_id"], batch["kinds"], batch["starts"], batch["ends"])):
                base = [(int(k), int(a), int(b)) for k, a, b in zip(ks, ss, es)]
                here = slice(ends[i] - sizes[i], ends[i])
                more = _added(*(flat[c][here] for c in ("start", "end", "joined", "held")), label[here])
                counts = [sum(k == x for k, _, _ in base) for x in range(len(KINDS))]
                out.append((doc_id, *counts, hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(sorted(base + more))))
            got = pd.DataFrame(out, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            yield got.astype({"doc_id": "Int64"})
        give_back()

    return found.mapInPandas(answer, _RESULT)
