import random
import tracemalloc
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from ludoscope import functions as fn
from ludoscope import operators as op
from ludoscope import plans
from ludoscope.operators import language, reconcile


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column, rows):
    schema = "x array<string>" if any(isinstance(r, list) for r in rows) else "x string"
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(column).collect()]


def test_scalars(spark):
    x = F.col("x")
    assert one(spark, fn.parse_bool(x), ["True", "TRUE", "true", "yes", "", None]) == [True, True, True, False, False, False]
    assert one(spark, fn.parse_list(x), ['"a,b"', "", None, '""c, d""', "a,,"]) == [["a", "b"], [""], [""], ["c", " d"], ["a", "", ""]]
    assert one(spark, fn.parse_int(x), ["1", "-2", "+3", " 1", "1.9", "", None, "99999999999"]) == [1, -2, 3, None, None, None, None, None]
    assert one(spark, fn.parse_float(x), ["1", "-2.5", "x", "", " 1", None]) == [1.0, -2.5, None, None, None, None]
    dates = ["Oct 21, 2008", "May 02, 2016", "May 2016", "", None, "2016-05-02", "Feb 30, 2012", " May 2, 2016"]
    assert one(spark, fn.extract_decade(x), dates) == [2000, 2010, 0, 0, 0, 0, 0, 0]
    assert one(spark, fn.array_contains_ci(x, "Indie"), [["INDIE"], ["indie games"], [" indie"], [], None, [None, "indie"]]) == [True, False, False, False, False, True]


def test_flag_totals(spark):
    games = spark.range(100).select(F.lit(1).alias("w"), (F.col("id") % 2 == 0).cast("int").alias("l"), (F.col("id") % 3 == 0).cast("int").alias("m"))
    assert values(op.flag_totals(games, ("w", "l", "m"))) == [(100, 50, 34)]
    assert values(op.flag_totals(games.limit(0), ("w", "l", "m"))) == [(0, 0, 0)]


def test_left_join_count(spark):
    games = spark.range(11).selectExpr("cast(id as string) app_id", "concat('g', id) name").unionAll(spark.createDataFrame([("3", "again")], "app_id string, name string"))
    reviews = spark.range(10).selectExpr("cast(id as string) app_id", "explode(sequence(1, 10 - cast(id as int))) k").unionAll(spark.createDataFrame([("77", 1)], "app_id string, k int"))
    got = dict(values(op.left_join_count(games, reviews, "app_id", ["name"])))
    assert got == {f"g{i}": 10 - i for i in range(11)} | {"again": 7}


def test_quantiles(spark):
    counts = spark.range(1, 101).selectExpr("id n", "concat('g', id) name")
    assert counts.agg(fn.quantile_index(F.count("*"), 90)).first()[0] == 90
    assert [r["n"] for r in op.sort_by_count(op.rows_at_or_above_quantile(counts, 90)).collect()] == list(range(91, 101))
    assert op.quantile_value(counts, 100).first()[0] == 0
    assert op.rows_at_or_above_quantile(counts, 100).count() == 100
    assert op.quantile_value(counts.where("n <= 10"), 90).first()[0] == 10
    assert op.rows_at_or_above_quantile(counts.limit(0), 90).count() == 0
    ties = spark.createDataFrame([(1, "a"), (5, "b"), (5, "c"), (5, "d")], "n long, name string")
    assert op.rows_at_or_above_quantile(ties, 90).count() == 3
    jobs = counts.withColumn("job_id", F.col("n") % 2)
    assert values(op.quantile_value(jobs, 90, by=("job_id",)).select("job_id", "value")) == [(0, 92), (1, 91)]


def test_top_n(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 2, 2), ("d", 0, 2)], "name string, n int, job_id int")
    assert [r["name"] for r in op.top_n(rows, 2, [F.desc("n"), F.asc("name")]).collect()] == ["b", "c"]
    assert op.top_n(rows, 9, [F.desc("n")]).count() == 4
    assert values(op.top_n(rows, 1, [F.desc("n"), F.asc("name")], by=("job_id",)).select("name")) == [("b",), ("c",)]


def test_folds_and_high_water(spark):
    log = spark.createDataFrame([("A", 1, 1, 0), ("A", 2, 2, 1), ("A", 2, 2, 2), ("B", 1, 4, 3), ("A", 1, 9, 4), ("B", 2, 5, 5), ("A", 3, 3, 6)], "origin string, sequence long, delta long, at int")
    assert values(op.last_sequence_per_origin(log)) == [("A", 3), ("B", 2)]
    assert values(op.fold_state_latest(log, "origin", "delta", ["at"])) == [("A", 3), ("B", 5)]
    kept = op.dedup_high_water(log, "origin", "sequence", ["at"], F.floor(F.col("at") / 2))
    assert values(kept.select("at")) == [(0,), (1,), (3,), (5,), (6,)]
    assert values(op.fold_state_sum(kept, "origin", "delta")) == [("A", 6), ("B", 9)]


def test_polarity_and_queries(spark):
    games = spark.createDataFrame([("1", "One", ["Action"], "Oct 21, 2012", 5.0), ("2", "Two", ["ACTION", "Indie"], "May 2, 2016", 7.0), ("3", "Three", ["Indie"], "bad", 9.0)], "app_id string, name string, genres array<string>, release_date string, avg_playtime_forever double")
    flags = games.withColumns({c: F.col("app_id") == "1" for c in ("windows", "linux", "mac")})
    reviews = spark.createDataFrame([("1", -1, "bad game")] * 3 + [("2", -1, "mal juego")] * 2 + [("2", 1, "good"), ("3", 0, "so")], "app_id string, review_score int, review_text string")
    got = plans.run_all(flags, reviews, lambda rows: rows.where("review_text like 'bad%'"), plans.Params(over=1, top_reviews=1))
    assert values(got["q1"]) == [(1, 1, 1)]
    assert values(got["q2"]) == [("Two", 7.0)]
    assert values(got["q3"]) == [("Two", 1)]
    assert values(got["q4"]) == [("One", 3)]
    assert values(got["q5"]) == [("One", 3)]
    spark.catalog.clearCache()


def test_language(spark):
    known = spark.createDataFrame([("en", "this is a good game and the story that is in it was great " * 3), ("es", "esto es un buen juego y la historia que hay en el fue una maravilla en español " * 3)], "lang string, text string")
    asked = spark.createDataFrame([(1, "This is a game that was in the story"), (2, "Esto es una historia en español"), (3, "zz"), (4, None), (5, "")], "id int, text string")
    weights = language.lang_train(known)
    assert values(language.lang_score(asked, weights, "id").select("id", language.label(F.col("score")))) == [(1, "en"), (2, "es"), (3, "unknown"), (4, "unknown"), (5, "unknown")]
    assert values(language.filter_language(asked, weights, "id").select("id")) == [(1,)]
    by_shuffle = language.lang_score(asked, weights, "id", broadcast=0)
    assert values(by_shuffle) == values(language.lang_score(asked, weights, "id"))


def test_trigram_counts(monkeypatch):
    """Against a plain loop, over cuts of long texts and more letters than fit a number."""
    r = random.Random(5)
    wide = [chr(c) for c in range(0x4E00, 0x4E00 + 20000)]
    texts = ["", "ab", "abc", None, "aaaa", "a\0b\0c" * 3, "".join(r.choice("abñ😀") for _ in range(500)), "".join(r.choice(wide) for _ in range(30000))]
    want = Counter((i, t[j : j + 3]) for i, t in enumerate(texts) if t for j in range(len(t) - 2))
    for run in (7, 1 << 20):
        monkeypatch.setattr(language, "RUN", run)
        got = Counter()
        for part in language._runs(pa.array(texts)):
            for i, tri, n in zip(*(x.tolist() if hasattr(x, "tolist") else x.to_pylist() for x in language._count(*part)), strict=True):
                got[i, tri] += n
        assert got == want


def test_trigram_counts_hold_little():
    """What is held beside a batch doesn't grow with it."""
    texts = pa.array([f"a text with number {i} " * 100 for i in range(2000)])
    tracemalloc.start()
    try:
        n = sum(int(language._count(*part)[2].sum()) for part in language._runs(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == sum(len(t.as_py()) - 2 for t in texts)
    assert peak < 32 << 20


def test_reconcile(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "name string, n int")
    b = spark.createDataFrame([("y\r", 2), (" x", 1), ("z", 3)], "name string, n int")
    assert values(reconcile.result_diff(a, b)) == [("x", "1", "missing"), ("z", "3", "extra")]
    assert values(reconcile.result_merge(a.distinct(), b.where("n = 3"))) == [("x", 1, None), ("y", 2, None)]


def test_quantile_of_distinct_values(spark):
    """Values nearly all distinct, a hot one, groups, nulls as a group, percentiles as a column."""
    rows = spark.range(30_000).select(((F.col("id") * 7919) % 30_011).alias("n"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("job"))
    rows = rows.union(spark.range(9_000).select(F.lit(12_345).cast("long"), F.lit(2).cast("long")))
    values = {}
    for r in rows.collect():
        values.setdefault(r.job, []).append(r.n)
    everything = sorted(v for own in values.values() for v in own)
    for p in (0, 1, 33.3, 50, 90, 99.99, 100):
        at = int(len(everything) * (p / 100.0))
        assert op.quantile_value(rows, p).first().value == (everything[at] if at < len(everything) else 0)
    asked = {None: 10.0, 1: 75.0, 2: 50.0}
    own = rows.withColumn("p", F.when(F.col("job") == 1, 75.0).when(F.col("job") == 2, 50.0).otherwise(10.0))
    got = {r.job: r.value for r in op.quantile_value(own, F.col("p"), by=["job", "p"]).collect()}
    assert got == {j: sorted(v)[int(len(v) * (asked[j] / 100.0))] for j, v in values.items()}
    cut = op.rows_at_or_above_quantile(own, F.col("p"), by=["job", "p"])
    assert cut.count() == sum(v >= got[j] for j, own in values.items() for v in own)
    assert op.quantile_value(rows.limit(0), 90).first().value == 0


def test_quantile_sends_only_sums_to_one_task(spark):
    """What one task gets are sketches and the sums of parts, never the values."""
    plan = op.quantile_value(spark.range(1000).select(F.col("id").alias("n")), 90)._jdf.queryExecution().executedPlan().toString().split("\n")
    to_one = [plan[i + 1].split("- ", 1)[1] for i, line in enumerate(plan) if "Exchange SinglePartition" in line]
    assert len(to_one) > 1
    for below in to_one:
        assert below.startswith(("HashAggregate(keys=[], ", "HashAggregate(keys=[__part#", "ObjectHashAggregate(keys=[], ", "SortAggregate(keys=[], ")), below
