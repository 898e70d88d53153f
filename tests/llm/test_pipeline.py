"""The stages on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ludoscope.llm import shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_the_columns_and_clean_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, docs, d).toPandas(), docs.schema)
        assert after.columns == COLUMNS, name
        assert after.where("n_chars <> length(text)").count() == 0
        assert 0.6 * before < after.count() <= docs.count()
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert packed.groupBy("doc_id").count().count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_on_odd_rows(spark):
    d = "/root/testdata/sf0.001"
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "no id", "en", "s", 5), (3, "long words " * 30000, "en", "s", 1)], empty.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0
        stage(spark, odd, d).collect()


def test_near_copies_go(spark):
    r = random.Random(10)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("ra", "sen", "tol", "vu", "xi") for c in ("a", "on", "ek")]
    rows = []
    for i in range(40):
        w = [r.choice(words) for _ in range(300)]
        rows.append((i, " ".join(w)))
        if i < 20:
            for k in r.sample(range(300), 3):  # a similarity of about 0.9 by five-word shingles
                w[k] = r.choice(words)
            rows.append((100 + i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    assert kept >= set(range(40)) and len(kept - set(range(40))) <= 1


@pytest.mark.parametrize("few", [16, 2])
def test_near_copies_are_those_of_brute_force(spark, few):
    r = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("ra", "sen", "tol", "vu", "xi") for c in ("a", "on", "ek")]
    texts = []
    for n in (3, 6, 15, 20, 60, 200):
        for _ in range(8):
            w = [r.choice(words) for _ in range(n)]
            texts.append(w)
            texts.append(r.sample(w, n))  # the same words in another order
            texts.append([*w[:-1], "end"])  # near where n is 15 or more
            texts.append([*w, *(r.choice(words) for _ in range(n // 8))])
            k = n // 2
            texts.append([*w[:k], "mid", *w[k + 1 :]])
            texts.append([r.choice(words) if i % 30 == 7 else x for i, x in enumerate(w)])  # a similarity of 0.5-0.7 for long ones
    crowd = [r.choice(words) for _ in range(100)]
    texts += [[*crowd[i % 4 :], f"x{i}"] for i in range(30)]

    def cut(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    own = [cut(w) for w in texts]
    label = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = shingles.near_duplicates(docs, corpus_pipeline.DIFFER, corpus_pipeline.BITS, few=few)
    by = {x.t: x.keeper for x in found.collect()}
    got = [by[int(np.array([shingles.shingle_set(" ".join(w), 5)[1]], np.uint64).view(np.int64)[0])] for w in texts]
    assert got == label
    kept = corpus_pipeline.near_dedup_stage(spark, docs.selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars"), "").collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(label))


def test_texts_go_to_workers_a_few_megabytes_at_a_time(spark):
    """Not 10,000 at a time, however long they are; a limit of the session's own stays."""
    from ludoscope.llm.common import BATCH, small_batches

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(400).selectExpr("repeat('some text ', 5000) AS text").coalesce(1)
    try:
        small_batches(spark)
        got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 400 and max(got) * 50_000 < 2 * BATCH
        spark.conf.set(name, "32m")
        small_batches(spark)
        assert spark.conf.get(name) in ("32m", str(32 << 20), f"{32 << 20}b")
    finally:
        spark.conf.unset(name)
