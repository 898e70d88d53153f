"""Classifiers, archives, vectors and graphs: against brute force and on odd rows."""

import hashlib
import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ludoscope.llm import embeddings, graph, quality, topk, toxicity, warc
from ludoscope.llm.common import crc_remainder
from ludoscope.llm.wording import words

# -- operators 1 and 3 -----------------------------------------------------------------


def test_ftrl_by_hand():
    """The updates against a loop over single weights."""
    g = np.random.default_rng(8)
    examples = [(np.sort(g.choice(12, 4, replace=False)), g.random(4), int(g.random() < 0.5)) for _ in range(60)]
    alpha, beta, l1, l2 = 0.7, 1.5, 0.05, 0.2
    got = quality.ftrl(examples, 12, 3, alpha, beta, l1, l2)
    z, n = [0.0] * 13, [0.0] * 13

    def weight(i):
        sign = (z[i] > 0) - (z[i] < 0)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - sign * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(3):
        for at, x, y in examples:
            pairs = [*zip(map(int, at), map(float, x), strict=True), (12, 1.0)]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                step = (p - y) * v
                sigma = ((n[i] + step * step) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += step - sigma * w[i]
                n[i] += step * step
    assert np.allclose(got, [weight(i) for i in range(13)], atol=1e-5)
    assert any(got)


def test_score_texts_window_by_window():
    """All windows of all texts at once against each window as a text of its own."""
    net = toxicity.new_net()
    g = np.random.default_rng(3)
    for k, v in net.items():
        net[k] = (v + g.normal(size=v.shape) * 0.2).astype(v.dtype)
    r = random.Random(2)
    texts = [" ".join(r.choice(["stone", "river", "Cloud", "wal", "seven", "idiot", "zzz"]) for _ in range(n)) for n in (1, 5, 15, 16, 17, 24, 25, 40, 333)]
    got = toxicity.score_texts(net, texts)
    for text, score in zip(texts, got, strict=True):
        w = text.split()
        starts = [0]
        while starts[-1] + toxicity.WINDOW < len(w):
            starts.append(starts[-1] + toxicity.STEP)
        one = [toxicity.score_texts(net, [" ".join(w[a : a + toxicity.WINDOW])])[0] for a in starts]
        assert abs(max(one) - score) < 1e-3
    assert len(set(np.round(got, 4))) > 5


def made_texts(spark, bad, n=240):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(["stone", "river", "cloud", "green", "walks", "under", "seven"]) for _ in range(r.randint(5, 60))]
        y = i % 3 == 0
        rows.append((i, bad(w, r) if y else " ".join(w)))
        labels.append((i, int(y)))
    rows += [(900, None), (901, ""), (902, "stone river " * 60000), (None, "no id"), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "y": F.lit(2), "h": F.lit(3)})
    return docs, spark.createDataFrame(labels + [(5, None), (None, 1), (777, 1)], "doc_id long, y int")


def test_quality(spark):
    docs, labels = made_texts(spark, lambda w, r: " ".join(x.upper() + "!!" for x in w))
    labels = labels.select("doc_id", (1 - F.col("y")).alias("quality"), "y")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and crc_remainder(r.doc_id, 5) == 0)
        if r.held_out and r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_dot_product_is_that_of_the_counts():
    texts = ["one two one two three", "", "A B c!", "é é"]
    w = np.random.default_rng(0).standard_normal(quality.BUCKETS + 1)
    for text in texts:
        (t, b, n), = quality.features([text])
        at, x = quality.sparse(t, b, int(n.sum()))
        assert np.isclose(w[at] @ x, quality.SCALE * w[b].sum() / max(n.sum(), 1))
        assert n.sum() == len(words([text.encode()]).start)


def test_toxicity(spark):
    def bad(w, r):
        w[r.randrange(len(w))] = r.choice(["scoundrel", "villain", "scoundrels!"])
        return " ".join(w)

    docs, labels = made_texts(spark, bad)
    labels = labels.select("doc_id", F.col("y").alias("toxic"))
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.held_out == (r.doc_id is not None and crc_remainder(r.doc_id, 4) == 2) for r in got)
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.classify(docs.limit(3), labels.limit(0)).collect()} == {0}


def test_gradients():
    r = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in toxicity.new_net().items()}
    x, mask, w = r.standard_normal((4, toxicity.WINDOW, 6 * toxicity.STATES)), np.ones((4, toxicity.WINDOW)), r.standard_normal(4)
    mask[0, 5:] = 0
    g, d_x = toxicity.backward(net, mask, toxicity.forward(net, x, mask, keep=True), w)
    for value, grad in [*((net[k], g[k]) for k in ("gh", "att", "out", "bias")), (x, d_x)]:
        for _ in range(3):
            i = tuple(int(r.integers(n)) for n in value.shape)
            old = value[i]
            value[i] = old + 1e-2
            up = toxicity.forward(net, x, mask) @ w
            value[i] = old - 1e-2
            down = toxicity.forward(net, x, mask) @ w
            value[i] = old
            assert abs((up - down) / 2e-2 - grad[i]) < 1e-3 * max(1, abs(grad[i]))


def test_all_words_are_in_overlapping_windows():
    for n in (1, 7, 16, 17, 24, 25, 100):
        first, own = toxicity.windows(np.zeros(n, np.int64))
        seen = set()
        for f in first:
            seen |= set(range(f, min(f + toxicity.WINDOW, n)))
        assert seen == set(range(n)) and (np.diff(first) == toxicity.STEP).all() and (own == 0).all()
    assert len(toxicity.windows(np.zeros(0, np.int64))[0]) == 0


# -- operator 2 ---------------------------------------------------------------------------


def test_round_trip(spark):
    big = "x" * 1000
    html = [None, "", "small", "small", big, big, big, "é" * 500, "é" * 500, "y" * 3_000_000, "a\r\n\r\nb" * 300]
    rows = [(i, f"http://e.org/{i} \r\nx", h) for i, h in enumerate(html)] + [(None, None, big), (6, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("payload", "digest", "refers_to")})
    got = warc.archive_and_read(pages).collect()
    assert len(got) == len(rows) and not [r for r in got if r.fault]
    last = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, -1), i)
    for r in got:
        if r.page_id is None:
            assert r.record_type == "response"
            continue
        h = html[r.page_id]
        raw = (h or "").encode()
        to = last.get(h, r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if to == r.page_id else ("revisit", to))
        assert bytes(r.payload) == (raw if to == r.page_id else b"")
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_dictionary_and_faults(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    files = warc.write(warc.marked(pages), f"file://{tmp_path}/w")
    assert warc.read(files).where("fault is null").count() == pages.count()
    path = files.first().path.removeprefix("file://")
    raw = open(path, "rb").read()
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_FRAME
    bodies = list(warc.frames(io.BytesIO(raw)))
    assert len(bodies) == files.first().records
    for cut in (3, 40, len(raw) // 2, len(raw) - 1):
        with pytest.raises(warc.Broken):
            list(warc.frames(io.BytesIO(raw[:cut])))
    one = bodies[0]
    head, _, block = one.partition(b"\r\n\r\n")
    for bad in (b"WARC/9" + one[6:], one[:-1], one + b"x", head.replace(b"WARC-Date", b"WARC Date") + b"\r\n\r\n" + block, head.replace(b"WARC-Type: response\r\n", b"") + b"\r\n\r\n" + block, one.replace(b"<html", b"<HTML", 1)):
        with pytest.raises(warc.Broken):
            warc.parse(bad)
    open(path, "wb").write(raw[: len(raw) - 9])
    assert {r.fault is None for r in warc.read(files).collect()} == {True, False}


# -- operators 7 and 8 ------------------------------------------------------------------------


def vectors(spark, n=300, odd=True):
    r = np.random.default_rng(8)
    centres = r.standard_normal((8, 16))
    x = np.concatenate([r.standard_normal((n // 2, 16)), centres[r.integers(8, size=n - n // 2)] + 0.12 * r.standard_normal((n - n // 2, 16))])
    x[5] = x[6] = x[7]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    if odd:
        rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [float("inf")] * 16), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [1e38] * 16), (1009, [1e-40] * 16)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(0) for c in ("key", "v", "rep", "table", "id", "n")})


@pytest.mark.parametrize(("shape", "most"), [(None, 2048), ((3, 60), 2048), ((2, 40), 20)])
def test_near_vectors(spark, shape, most):
    rows, df = vectors(spark)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, recall=0.9999, shape=shape, most=most).collect()}
    assert len(got) == len(rows)
    x = np.array([v for i, v in rows if i < 1000], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min(label[i], *label[near[i]]) if near[i].any() else label[i] for i in range(len(x))])
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), label[i], label[i] == i)
    for i in (1000, 1001, 1002, 1003, 1004, 1005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[1006].n_links, got[1007].component_id) == (1, 1006)
    assert (got[1008].n_links, got[1009].component_id) == (1, 1008)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("k", "q", "c"), [(20, 1024, 4096), (3, 4, 16), (500, 8, 64)])
def test_top_k(spark, k, q, c):
    rows, df = vectors(spark)
    rows = [(i, v) for i, v in rows if i < 1000 or i in (1001, 1005, 1006, 1007)]
    fine = topk.scaled(df.where("vec_id not in (1008, 1009)"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(fine, fine.where("id % 20 = 0 or id > 1000"), k, query_block=q, candidate_block=c).collect())
    ints = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(np.float64)).astype(np.int64) for i, v in rows}
    told = []
    for a, x in ints.items():
        if a % 20 == 0 or a > 1000:
            best = sorted((-int(x @ y), b) for b, y in ints.items() if b != a and len(x) == len(y))[:k]
            told += [(a, n + 1, b, -s) for n, (s, b) in enumerate(best)]
    assert got == sorted(told)
    assert topk.top_k(fine.limit(0), fine.limit(0), k).count() == 0


def test_blocks_are_never_broadcast_nor_made_by_one_task(spark):
    """However small Spark takes blocks to be: the copies that meet grow with the square."""
    rows = spark.range(600).select("id", F.array(F.col("id") % 7, F.col("id") % 5).alias("v")).localCheckpoint()
    asked = rows.where("id % 20 = 0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = topk.blocks(rows, 8, "c")
        assert made.select(F.spark_partition_id()).distinct().count() > 1
        queries = topk.blocks(asked, 8, "q")
        met = topk.meet(queries, made, topk.n_pairs(asked, made, 8))
        assert len({(r.q, r.c) for r in met.collect()}) == met.count() == queries.count() * made.count()
        plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin" in plan and met.select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("high", [3, 40, 70_000, 2**33, 2**40])
def test_top_k_phases_look_up_few(high):
    """The cutoff leaves out most entries, and none of the best; components of any size."""
    g = np.random.default_rng(4)
    q, c = (np.floor(g.normal(size=(n, 32)) * high).astype(np.int64) for n in (30, 2000))
    full = q.astype(object) @ c.T.astype(object)
    best = np.sort(full, axis=1)[:, -20:]
    own = list(topk.partial_scores(q, c, topk.LISTS))
    first = topk.best_entries(own, 20)
    assert len(first) <= 30 * 20 * topk.LISTS
    told = topk.looked_up(own, first)
    assert [int(x) for x in told] == [(int(x) + 2**63) % 2**64 - 2**63 for x in full.ravel()[first]]
    if high < 2**33:  # within 64 bits
        cutoff = np.array([np.sort(told[first // 2000 == i])[-20] for i in range(30)])
        assert all(cutoff <= best[:, 0])
        at = topk.sufficient_entries(own, cutoff)
        assert len(at) < full.size / 3
        assert set(np.flatnonzero((full >= best[:, :1]).ravel())) <= set(at)


def test_top_k_forms_each_list_once_a_phase(monkeypatch):
    """Both phases together take the multiply-adds of two block products."""
    g = np.random.default_rng(4)
    q, c = (np.floor(g.normal(size=(n, 32)) * 40).astype(np.int8) for n in (30, 500))
    done, real = [], topk.partial_scores

    def counted(a, b, lists):
        for p in real(a, b, lists):
            done.append(p.size)
            yield p

    monkeypatch.setattr(topk, "partial_scores", counted)
    row = {"dim": 32, "q_id": np.arange(30).tobytes(), "q_v": q.tobytes(), "c_id": np.arange(500).tobytes(), "c_v": c.tobytes(), "q_cutoff": np.full(30, 10_000).tobytes()}
    list(topk.local_best(row, 20, topk.LISTS)), list(topk.sufficient(row, 20, topk.LISTS))
    assert sum(done) == 2 * topk.LISTS * 30 * 500  # of 32 / LISTS components each


# -- graphs ---------------------------------------------------------------------------------------


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    label = {i: i for e in edges for i in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert all(got.get(i, i) == m for i, m in label.items())
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_buckets_in_parts(spark):
    df = spark.range(500).selectExpr("id % 3 as key", "id as rep")
    counts = df.groupBy("key").agg(F.count("*").alias("__count"))

    def linked(bucket):
        x = bucket["rep"].to_numpy()
        return lambda i, rest: abs(x[rest] - x[i]) <= 3

    for most in (4096, 20):
        got = {x.node: x.component for x in graph.components(graph.bucket_links(df, ["key"], "rep", counts, linked, most)).collect()}
        assert got == {i: i % 3 for i in range(3, 500)}


def test_examples_take_three_bytes_an_ngram():
    rng = np.random.default_rng(0)
    for n, most in ((0, 1), (1, 1), (900, 3), (5000, 100_000)):
        at = np.sort(rng.choice(quality.BUCKETS, n, replace=False))
        count = rng.integers(1, most + 1, n)
        raw = quality.shortened(at, count)
        got = quality.lengthened(memoryview(raw))
        assert np.array_equal(got[0], at) and np.array_equal(got[1], count)
        assert most > 255 or len(raw) == 3 * n + 20
