"""Toxicity: a bidirectional gated recurrent network with attention pooling (operator 3).

A text is a sequence of words and marks. Each is given by a hashed word vector plus the
mean of hashed vectors of its character trigrams; a gated recurrent unit reads every
window of the sequence in both directions, attention pools its states, and a logistic
unit scores the window. Windows overlap by half; a text's score is that of its highest
window, all windows of the whole text being scored. The network is trained in numpy on
a bounded sample of labelled texts, in one task; scoring runs where the texts lie.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, remainder
from .quality import picked
from .wording import RUN, Words, segments, windowed, words

#: Size of the network: word and trigram buckets, width of their vectors, of the states.
WORDS, TRIGRAMS, WIDTH, STATES = 1 << 14, 1 << 13, 16, 10
#: Words in a window, and from one window's start to the next.
WINDOW, STEP = 16, 8
#: Labelled rows that the network is trained on at most, and the windows of each in a step.
SAMPLE, SAMPLE_WINDOWS = 8_192, 32
#: Training steps, texts in each, and the rate.
STEPS, BATCH, RATE = 800, 48, 0.01
#: Chance in training that a word loses its own vector.
WORD_LOSS = 0.3

Net = dict[str, np.ndarray]


def new_net(seed: int = 11) -> Net:
    """Random weights. ``gx``, ``gh``, ``gb``: inputs to the gates (update, reset, new) of the
    forward direction, then of the backward one."""
    r = np.random.default_rng(seed)

    def some(*shape: int, scale: float) -> np.ndarray:
        return (r.standard_normal(shape) * scale).astype(np.float32)

    return {
        "word": some(WORDS, WIDTH, scale=0.1), "tri": some(TRIGRAMS, WIDTH, scale=0.3),
        "gx": some(WIDTH, 6 * STATES, scale=0.5), "gh": some(2, STATES, 3 * STATES, scale=0.3), "gb": np.zeros(6 * STATES, np.float32),
        "att": some(2 * STATES, scale=0.3), "out": some(2 * STATES, scale=0.5), "bias": np.full(1, -1.0, np.float32),
    }


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word its number among the distinct ones; for those their word bucket, and
    the buckets of all their trigrams one after the other with where each word's begin."""
    _, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
    start, length = w.start[first], w.end[first] - w.start[first]
    begin = np.concatenate([[0], np.cumsum(length)])[:-1]
    at = np.repeat(start - begin, length) + np.arange(int(length.sum()))
    now = w.raw[at].astype(np.int64)
    before, after = np.where(at == np.repeat(start, length), 2, w.raw[np.maximum(at - 1, 0)]), np.where(at == np.repeat(start + length - 1, length), 3, w.raw[np.minimum(at + 1, len(w.raw) - 1)])
    tri = (before.astype(np.int64) * 0x9E3779B1 + now * 0x85EBCA77 + after.astype(np.int64) * 0xC2B2AE3D >> 7) % TRIGRAMS
    return number, (w.hash[first] >> np.uint64(20)).astype(np.int64) % WORDS, tri, begin


def windows(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window, and its text. Each text of n words has windows at 0,
    STEP, 2 STEP, ... as long as words are left that no window before covers."""
    n = np.bincount(text) if len(text) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(n)])[:-1]
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STEP)))
    own = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(own)) - np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1], count)
    return begin[own] + k * STEP, own


def inputs(net: Net, word: np.ndarray, tri: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The vector of each distinct word."""
    if not len(word):
        return np.zeros((0, WIDTH), np.float32)
    length = np.diff(np.append(begin, len(tri)))
    return net["word"][word] + np.add.reduceat(net["tri"][tri], begin, axis=0) / length[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(net: Net, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. ``x``: (windows, WINDOW, 6 STATES) gate inputs; ``mask``: which words
    are there. With ``keep``, also what the way back needs."""
    n, h = len(x), STATES
    states = np.zeros((n, WINDOW, 2 * h), np.float32)
    trace = []
    for d in (0, 1):
        s = np.zeros((n, h), np.float32)
        u, own = net["gh"][d], slice(3 * h * d, 3 * h * (d + 1))
        for t in range(WINDOW) if d == 0 else reversed(range(WINDOW)):
            a, b = x[:, t, own], s @ u
            zr = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            m = mask[:, t, None]
            after = s + m * (1 - z) * (c - s)
            if keep:
                trace.append((d, t, s, z, r, c, b[:, 2 * h :]))
            s = after
            states[:, t, h * d : h * (d + 1)] = s
    e = states @ net["att"] + np.where(mask > 0, 0, -1e9).astype(np.float32)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    a = e / e.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,nts->ns", a, states)
    logit = pooled @ net["out"] + net["bias"][0]
    return (logit, states, a, pooled, trace) if keep else logit


def backward(net: Net, mask: np.ndarray, kept, d_logit: np.ndarray) -> tuple[Net, np.ndarray]:
    """Gradients of the weights behind the gates, and of the gate inputs."""
    _, states, a, pooled, trace = kept
    h = STATES
    g: Net = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32), "gh": np.zeros_like(net["gh"])}
    d_pooled = d_logit[:, None] * net["out"]
    d_a = np.einsum("nts,ns->nt", states, d_pooled)
    d_e = a * (d_a - (a * d_a).sum(axis=1, keepdims=True))
    g["att"] = np.einsum("nt,nts->s", d_e, states)
    d_states = a[:, :, None] * d_pooled[:, None, :] + d_e[:, :, None] * net["att"]
    d_x = np.zeros((len(mask), WINDOW, 6 * h), np.float32)
    carry, last = np.zeros((len(mask), h), np.float32), 1
    for d, t, s, z, r, c, bc in reversed(trace):
        if d != last:
            carry, last = np.zeros_like(carry), d
        m = mask[:, t, None]
        ds = carry + d_states[:, t, h * d : h * (d + 1)]
        dc = ds * m * (1 - z) * (1 - c * c)
        dz = -ds * m * (c - s) * z * (1 - z)
        dr = dc * bc * r * (1 - r)
        da = np.concatenate([dz, dr, dc], axis=1)
        db = np.concatenate([dz, dr, dc * r], axis=1)
        d_x[:, t, 3 * h * d : 3 * h * (d + 1)] = da
        g["gh"][d] += s.T @ db
        carry = ds * (1 - m * (1 - z)) + db @ net["gh"][d].T
    return g, d_x


def summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places in ``at`` and the sum of the rows of each."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return own[first], np.add.reduceat(rows[order], first, axis=0)


class Text:
    """A whole labelled text, ready for training."""

    def __init__(self, text: str, label: int):
        parts, *_ = segments([text])
        got = [distinct(words([p])) for p in parts]
        shift = np.cumsum([0, *(len(g[1]) for g in got)])
        self.number = np.concatenate([g[0] + k for g, k in zip(got, shift, strict=False)]).astype(np.int32)
        self.word = np.concatenate([g[1] for g in got]).astype(np.int32)
        self.tri = np.concatenate([g[2] for g in got]).astype(np.int32)
        # where the trigrams of each distinct word begin, and the end
        self.begin = np.concatenate([*(g[3] + sum(len(x[2]) for x in got[:k]) for k, g in enumerate(got)), [len(self.tri)]]).astype(np.int64)
        self.start, _ = windows(np.zeros(len(self.number), np.int64))
        self.label = label

    def trigrams(self, of: np.ndarray) -> list[np.ndarray]:
        return [self.tri[self.begin[u] : self.begin[u + 1]] for u in of.tolist()]

    def some(self, r: np.random.Generator) -> np.ndarray:
        """Windows of the whole text to learn from in a step: all, or as many drawn from all."""
        return self.start if len(self.start) <= SAMPLE_WINDOWS else r.choice(self.start, SAMPLE_WINDOWS, replace=False)


def train_net(texts: list[Text], steps: int | None = None, rate_of_ones: float = 0.5, seed: int = 5) -> Net:
    """Adam on batches with as many toxic texts as others; at the end the bias is set right
    for the true share of toxic ones. A text's logit is the mean of its windows' weighted by
    their own softmax, which sharpens to the highest window. At random, words lose their own
    vector and keep that of their characters. Few texts get fewer steps."""
    net = new_net()
    steps = steps or min(STEPS, 100 + len(texts) // 3)
    groups = [[t for t in texts if t.label == y and len(t.start)] for y in (0, 1)]
    if not groups[0] or not groups[1]:
        net["out"][:] = 0
        net["bias"][:] = -4.0 if groups[0] or not groups[1] else 4.0
        return net
    r = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    for step in range(1, steps + 1):
        sharp = 0.5 + 5.5 * step / steps
        batch = [g[int(i)] for g in groups for i in r.integers(len(g), size=BATCH // 2)]
        number, word, tri, owner = [], [], [], []
        for k, t in enumerate(batch):
            s = t.some(r)
            at = s[:, None] + np.arange(WINDOW)
            there = at < len(t.number)
            ids = np.where(there, t.number[np.minimum(at, len(t.number) - 1)], -1)
            used, place = np.unique(ids, return_inverse=True)
            used = used[used >= 0]
            number.append(np.where(there, place.reshape(ids.shape) - (ids.min() < 0) + len(word), -1))
            word += t.word[used].tolist()
            tri += t.trigrams(used)
            owner += [k] * len(s)
        number, owner = np.concatenate(number), np.array(owner)
        mask = (number >= 0).astype(np.float32)
        word = np.array(word)
        begin = np.concatenate([[0], np.cumsum([len(t) for t in tri])])[:-1]
        flat = np.concatenate(tri)
        heard = (r.random(len(word)) > WORD_LOSS).astype(np.float32)[:, None]
        v = inputs(net, word, flat, begin) - (1 - heard) * net["word"][word]
        x = (v @ net["gx"] + net["gb"])[np.maximum(number, 0)]
        kept = forward(net, x, mask, keep=True)
        logit = kept[0].astype(np.float64)
        e = np.exp(sharp * logit - np.maximum.reduceat(sharp * logit, np.searchsorted(owner, range(len(batch))))[owner])
        share = e / np.bincount(owner, e)[owner]
        total = np.bincount(owner, share * logit)
        wrong = 1 / (1 + np.exp(-total)) - np.array([t.label for t in batch])
        g, d_x = backward(net, mask, kept, (wrong[owner] * share / len(batch)).astype(np.float32))
        d_gate = np.zeros((len(word), x.shape[2]), np.float32)
        at, d = summed(number[mask > 0], d_x[mask > 0])
        d_gate[at] = d
        g["gb"], g["gx"] = d_gate.sum(axis=0), v.T @ d_gate
        d_v = d_gate @ net["gx"].T
        rows: dict[str, tuple[np.ndarray, np.ndarray]] = {"word": (word, d_v * heard)}
        length = np.diff(np.append(begin, len(flat)))
        rows["tri"] = (flat, np.repeat(d_v / length[:, None].astype(np.float32), length, axis=0))
        rate = RATE * min(1, 2 * (1 - step / (steps + 1))) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, (at, d) in rows.items():  # only the rows of vectors that the batch uses
            at, own = summed(at, d)
            first[k][at] = 0.9 * first[k][at] + 0.1 * own
            second[k][at] = 0.999 * second[k][at] + 0.001 * own * own
            net[k][at] -= rate * first[k][at] / (np.sqrt(second[k][at]) + 1e-8) + rate * 1e-3 * net[k][at]
        for k, d in g.items():
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            net[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    ones = min(max(rate_of_ones, 1e-4), 1 - 1e-4)
    net["bias"] += np.float32(np.log(ones / (1 - ones)))
    return net


def score_texts(net: Net, texts: list[str]) -> np.ndarray:
    """The logit of each text's highest window; that of an empty window for no words."""
    best = np.full(len(texts), -np.inf)
    parts, which = windowed(texts, WINDOW, STEP)
    at = 0
    while at < len(parts):
        size, a = 0, at
        while at < len(parts) and (size == 0 or size + len(parts[at]) <= RUN):
            size += len(parts[at])
            at += 1
        w = words(parts[a:at])
        if not len(w.start):
            continue
        number, word, tri, begin = distinct(w)
        gates = inputs(net, word, tri, begin) @ net["gx"] + net["gb"]
        first, own = windows(w.text)
        last = np.cumsum(np.bincount(w.text))
        for k in range(0, len(first), 4000):
            f, o = first[k : k + 4000], own[k : k + 4000]
            place = f[:, None] + np.arange(WINDOW)
            mask = (place < last[o][:, None]).astype(np.float32)
            logit = forward(net, gates[number[np.minimum(place, len(number) - 1)]], mask)
            np.maximum.at(best, which[a:at][o], logit)
    return np.where(np.isinf(best), net["bias"][0], best)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = (4, 2), most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Net:
    """The network, trained on at most ``most`` labelled texts outside the held-out part: a
    quarter of them labelled 1, or all there are if they are fewer, so that the rarer label
    isn't wanting, and at most three quarters labelled 0. Whole texts are learnt from: each step
    draws from all windows of a text."""
    rare = picked(labels.where(F.col(label) == 1), label, held_out, most // 4, id_col)
    rest = picked(labels.where(F.col(label) == 0), label, held_out, most - most // 4, id_col)
    mod, rest_of = held_out
    share = labels.where(remainder(id_col, mod) != rest_of).agg(F.avg(F.col(label).cast("double"))).first()[0]
    sample = rare.union(rest).groupBy("__id").agg(F.max("y").alias("y"), F.max("h").alias("h"))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "__id")  # `most` rows at most

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = train_net([Text(r["text"], r["y"]) for b in batches for r in b.to_pylist()], rate_of_ones=share or 0.0)
        out = io.BytesIO()
        np.savez(out, **net)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    fitted = rows.select("text", "y", "h").repartition(1).sortWithinPartitions("h", "text", "y").mapInArrow(fit, "model binary").collect()
    if not fitted:
        return train_net([])
    return dict(np.load(io.BytesIO(fitted[0]["model"])))


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score double`` for each row. A null text is empty; texts without words score
    by the bias alone; equal texts score alike up to rounding; an empty table gives an empty one."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # as large as the network
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    schema = rows.drop("__text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in in_pieces(batch.column(1), RUN):
                logit = score_texts(model.value, part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30))))], schema.names)
                at += len(part)

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = (4, 2), threshold: float = 0.3, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out boolean, score double, predicted int`` for each row of ``docs``.

    Rows whose crc32(id as text) modulo ``held_out[0]`` is ``held_out[1]`` are never learnt
    from; a null id isn't held out. ``predicted`` is 1 from ``threshold`` on.
    """
    got = score(docs, train(docs, labels, label, held_out, most, id_col, text_col), id_col, text_col)
    mod, rest = held_out
    return got.select(id_col, F.coalesce(remainder(id_col, mod) == rest, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
