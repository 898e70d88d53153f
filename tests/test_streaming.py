import os
import random

from pyspark.sql import functions as F

from ludoscope import store, streaming
from ludoscope.streaming import barrier, keyed, outbox


def test_restart_goes_on(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))

    def add(lo, hi):
        spark.range(lo, hi).selectExpr("id % 3 as key", "id as sequence", "'o' as origin").coalesce(1).write.mode("append").parquet(src)

    add(0, 50)
    schema = spark.read.parquet(src).schema

    def run():
        counts = streaming.stateful_count(streaming.stream_ingest(spark, src, schema, files=1), "key")
        streaming.until_inputs_end(counts, streaming.replace_result(out), check, "complete")
        return sum(r.n for r in spark.read.parquet(out).collect())

    assert run() == 50
    add(50, 100)
    assert run() == 100


def test_sink_takes_a_batch_twice(spark, tmp_path):
    out = str(tmp_path / "out")
    each = streaming.idempotent_sink(out, ("origin", "sequence"))
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "origin string, sequence int")
    for _ in range(2):
        each(batch, 0)
    assert spark.read.parquet(out).count() == 2


def test_high_water_and_top(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("A", s, i) for i, s in enumerate([1, 2, 2, 3, 3, 3, 1, 4])] + [("B", 5, 8), ("B", 4, 9)]
    df = spark.createDataFrame(rows, "origin string, sequence long, at long").coalesce(1)
    df.write.parquet(src)
    stream = streaming.stream_ingest(spark, src, df.schema)
    sink = streaming.stream_high_water(str(tmp_path / "o"), "origin", "sequence", ["at"], F.floor(F.col("at") / 3))
    streaming.until_inputs_end(stream, sink, str(tmp_path / "c"))
    sink(spark.createDataFrame([("A", 4, 20), ("A", 6, 21), ("B", 7, 22), ("B", 6, 23), ("C", 1, 24)], df.schema), 1)
    assert sorted((r.origin, r.sequence) for r in spark.read.parquet(str(tmp_path / "o/rows/batch=1")).collect()) == [("A", 6), ("B", 7), ("C", 1)]
    assert sorted((r.origin, r.sequence) for r in spark.read.parquet(str(tmp_path / "o/rows/batch=0")).collect()) == [("A", 1), ("A", 2), ("A", 3), ("A", 4), ("B", 5)]
    top = streaming.stateful_top_n(str(tmp_path / "t"), 2, [F.desc("sequence"), F.asc("at")])
    for i in range(3):
        top(df.where(F.col("at") % 3 == i), i)
    assert sorted(r.sequence for r in spark.read.parquet(str(tmp_path / "t/2")).collect()) == [4, 5]


def test_output_resumes_half_way(spark, tmp_path):
    """Stopped after 50 of 100 rows, the sink goes on and gives none twice."""
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    for i in range(4):
        spark.range(i * 25, i * 25 + 25).coalesce(1).write.mode("append").parquet(src)
    stream = streaming.stream_ingest(spark, src, "id long", files=1)
    sink = streaming.idempotent_sink(out)

    def dies(batch, batch_id):
        sink(batch, batch_id)  # written, but not acknowledged
        if batch_id == 1:
            raise RuntimeError("lost")

    try:
        streaming.until_inputs_end(stream, dies, check)
    except Exception as e:
        assert "lost" in str(e)
    assert spark.read.parquet(out).count() == 50
    streaming.until_inputs_end(stream, sink, check)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(100))


def _files(path):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_keyed_counts_write_what_changed(spark, tmp_path):
    path = str(tmp_path / "k")
    static = spark.range(200).select(F.col("id").alias("key"), F.concat(F.lit("n"), "id").alias("name"))

    def counts(*rows):
        return spark.createDataFrame(list(rows), "key long, n long")

    def told():
        return {r.name: r.n for r in keyed.keyed_counts(static, "key", ["name"], path, 8).collect()}

    each = keyed.keyed_join_count(static, "key", ["name"], path, 8)
    each(counts((3, 2), (5, 1), (900, 4)), 0)
    want = {f"n{i}": 0 for i in range(200)} | {"n3": 2, "n5": 1}
    assert told() == want
    before = _files(f"{path}/rows")
    each(counts((7, 6)), 1)  # one key: one file, in one bucket
    new = set(_files(f"{path}/rows")) - set(before)
    assert len(new) == 1 and "/batch=1/bucket=" in new.pop()
    assert told() == want | {"n7": 6}
    manifest = store.read_text(spark, f"{path}/manifests/1.json")
    each(counts((7, 6)), 1)  # again
    assert told() == want | {"n7": 6} and store.read_text(spark, f"{path}/manifests/1.json") == manifest
    each(counts(), 2)
    for i in range(3, 9):
        each(counts((7, 6 + i), (i, 1)), i)
    assert told() == want | {"n7": 14} | {f"n{i}": 1 for i in (4, 5, 6, 8)} | {"n3": 1}
    assert len(_files(f"{path}/rows")) <= 8 + 4  # old versions go


def test_half_a_batch_is_not_read(spark, tmp_path):
    path = str(tmp_path / "k")
    rows = keyed.KeyedTable(spark, path, ["key"], "key long, n long", 4)
    rows.change(0, spark.createDataFrame([(1, 1), (None, 2)], "key long, n long"), lambda _, new: new)
    spark.createDataFrame([(1, 99, 0)], "key long, n long, bucket int").write.partitionBy("bucket").parquet(f"{path}/rows/batch=1")  # no manifest yet
    assert sorted(map(tuple, rows.read().collect()), key=repr) == [(1, 1), (None, 2)]


def test_top_of_changing_counts(spark, tmp_path):
    """After each of 20 batches the same as a full sort, also when counts fall."""
    rng = random.Random(2)
    top = keyed.MaintainedTop(spark, str(tmp_path / "t"), 3, "key long, n long", "key", slack=2)
    now = {}
    for batch in range(20):
        changed = {rng.randrange(60): rng.randrange(100) for _ in range(rng.choice([0, 2, 12]))}
        if batch % 5 == 4:  # all that lead fall
            changed |= {k: 0 for k in sorted(now, key=lambda k: -now[k])[:5]}
        now |= changed
        df = spark.createDataFrame(list(changed.items()), "key long, n long")
        for _ in range(1 + (batch % 7 == 3)):  # sometimes twice
            top.each(df, batch)
        want = sorted(now.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [tuple(r) for r in top.read().collect()] == want, batch
        assert spark.read.parquet(str(tmp_path / f"t/candidates/batch={batch}")).count() <= 7  # n * slack, and the bound
    assert 0 < top.repairs < 8


def test_high_water_by_key(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("A", s, i) for i, s in enumerate([1, 2, 2, 3, 3, 3, 1, 4])] + [("B", 5, 8), ("B", 4, 9), (None, 1, 10), (None, 1, 11)]
    df = spark.createDataFrame(rows, "origin string, sequence long, at long").coalesce(1)
    df.write.parquet(src)
    sink = keyed.high_water(str(tmp_path / "o"), "origin", "sequence", ["at"], F.floor(F.col("at") / 3), 4)

    def run():
        streaming.until_inputs_end(streaming.stream_ingest(spark, src, df.schema), sink, str(tmp_path / "c"))

    def told(batch):
        return sorted(((r.origin, r.sequence) for r in spark.read.parquet(str(tmp_path / f"o/rows/batch={batch}")).collect()), key=repr)

    run()
    assert told(0) == [("A", 1), ("A", 2), ("A", 3), ("A", 4), ("B", 5), (None, 1)]
    more = spark.createDataFrame([("A", 4, 20), ("A", 6, 21), ("B", 7, 22), ("B", 6, 23), ("C", 1, 24), (None, 1, 25)], df.schema).coalesce(1)
    more.write.mode("append").parquet(src)
    run()  # a restart goes on from the state
    assert told(1) == [("A", 6), ("B", 7), ("C", 1)]
    sink(more, 1)  # the batch again
    assert told(1) == [("A", 6), ("B", 7), ("C", 1)]
    state = keyed.KeyedTable(spark, str(tmp_path / "o/high"), ["origin"], "origin string, __high long", 4)
    assert sorted(map(tuple, state.read().collect()), key=repr) == [("A", 6), ("B", 7), ("C", 1), (None, 1)]


SAID = "job_id long, table string, origin int, app_id long, ends boolean"


def test_jobs_end_one_by_one(spark, tmp_path):
    told = []

    def answer(rows, ended):
        told.append((sorted(r.job_id for r in ended.collect()), sorted((r.job_id, r.app_id) for r in rows.collect())))

    each = barrier.answer_when_ended(str(tmp_path / "b"), F.col("ends"), {"games": 1, "reviews": 2}, answer, buckets=4)

    def batch(number, *rows):
        each(spark.createDataFrame(list(rows), SAID), number)
        return told[-1] if told else None

    def row(job, app):
        return (job, "reviews", None, app, False)

    def end(job, table, origin):
        return (job, table, origin, None, True)

    assert batch(0, row(0, 5), row(1, 6), end(0, "reviews", 0), end(0, "reviews", 0), end(0, "games", 0)) is None  # one origin twice
    assert batch(1, row(0, 7), end(0, "reviews", 0)) is None
    assert batch(2, row(0, 8), end(0, "reviews", 1)) == ([0], [(0, 5), (0, 7), (0, 8)])  # the other still waits
    assert len(told) == 1
    batch(2, row(0, 8), end(0, "reviews", 1))  # again: the same
    assert told[1] == told[0]
    batch(3, row(1, 9), end(1, "reviews", 0), end(1, "reviews", 1), end(0, "reviews", 1))
    assert len(told) == 2  # the games of job 1 haven't ended
    assert batch(4, end(1, "games", 3), end(2, "games", 0)) == ([1], [(1, 6), (1, 9)])
    assert len(told) == 3


def test_large_job_is_kept_by_many_tasks(spark, tmp_path, monkeypatch):
    """A job of many rows doesn't go through one task; small ones stay in one file."""
    monkeypatch.setattr(barrier, "IN_TASK", 50)
    own = spark.newSession()  # small partitions stay apart
    own.conf.set("spark.sql.adaptive.enabled", "false")
    got = []
    each = barrier.answer_when_ended(str(tmp_path / "b"), F.col("ends"), {"reviews": 1}, lambda rows, _: got.extend(sorted((r.job_id, r.app_id) for r in rows.collect())), buckets=4)
    rows = [(0, "reviews", None, 7, False)] * 1000 + [(1, "reviews", None, k, False) for k in range(20)] + [(None, "reviews", None, 3, False)] * 200
    ends = [(0, "reviews", 0, None, True), (1, "reviews", 0, None, True)]
    each(own.createDataFrame(rows + ends, SAID).repartition(3), 0)
    assert got == [(0, 7)] * 1000 + [(1, k) for k in range(20)]
    files = {d: len(list((tmp_path / "b" / "rows" / "__batch=0" / f"__job={d}").glob("*.parquet"))) for d in ("10", "11", "0")}
    assert files["10"] > 1 and files["0"] > 1 and files["11"] == 1


def test_batches_are_read_by_many_tasks(spark, tmp_path):
    """Rows of many splits come in four batches, each of several files."""
    from ludoscope.queries import _in_batches

    told, rows = [], []

    def each(batch, _):
        told.append(batch.select(F.input_file_name()).distinct().count())
        rows.extend(r.id for r in batch.collect())

    streaming.until_inputs_end(_in_batches(spark.range(900, numPartitions=9)), each, str(tmp_path / "c"))
    assert told == [3] * 4 and sorted(rows) == list(range(900))


def test_output_goes_on_after_a_row(spark, tmp_path):
    """Stopped after row 37 of a batch of 50, the sink gives the rest once."""
    src, taken = str(tmp_path / "src"), []
    spark.range(50).coalesce(1).write.parquet(src)
    stream = streaming.stream_ingest(spark, src, "id long", files=1)

    def run(most):
        def send(row):
            if len(taken) == most:
                raise RuntimeError("lost")
            taken.append((row.place, row.id))

        streaming.until_inputs_end(stream, outbox.outbox_sink(str(tmp_path / "out"), [F.desc("id")], send), str(tmp_path / "check"))

    try:
        run(37)
    except Exception as e:
        assert "lost" in str(e)
    assert len(taken) == 37
    spark.range(50, 60).coalesce(1).write.mode("append").parquet(src)
    run(None)
    assert taken == [(i + 1, 49 - i) for i in range(50)] + [(i + 1, 59 - i) for i in range(10)]


def test_outbox(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 7).alias("key"), "id").union(spark.createDataFrame([(None, 3), (1, 1), (1, 1)], "key long, id long"))
    box = outbox.Outbox(spark, str(tmp_path / "o"), rows.schema)
    box.fill(rows, [F.asc_nulls_last("key")])
    want = sorted(((r.key, r.id) for r in rows.collect()), key=lambda r: (r[0] is None, r))
    box.fill(rows.limit(3), ["key"])  # filled already: stays
    for after in (0, 400, 999, 1003):
        box.confirm(after)
        got = sorted(map(tuple, box.pending().collect()))
        assert got == [(i + 1, *want[i]) for i in range(after, 1003)]
    box.confirm(5)  # not back
    assert box.confirmed() == 1003
    none = outbox.Outbox(spark, str(tmp_path / "n"), rows.schema)
    none.fill(rows.limit(0), ["key"])
    assert none.pending().collect() == [] and none.pending().columns == ["place", "key", "id"]
