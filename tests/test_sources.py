import random

import pytest

from ludoscope import sources
from ludoscope.sources import published, quoted


@pytest.fixture
def files(tmp_path):
    game = ["20200", 'A "b", c', "Oct 21, 2008", *[""] * 14, "True", "false", "TRUE", *[""] * 9, "1", "2.5", "0", "0", "D", "P", "w,x,y,z", "Action,Indie", "", "", ""]
    bad = [*game[:29], "much", *game[30:]]

    def line(fields):
        return ",".join('"' + f.replace('"', '""') + '"' for f in fields)

    (tmp_path / "my_games.csv").write_text("\n".join([",".join(map(str, range(40))), line(game), line(bad)]) + "\n")
    (tmp_path / "reviews.csv").write_text('app_id,app_name,review_text,review_score,review_votes\n1,n,"two\nlines, ""quoted""",1,0\n2,n,,x,0\n3,n,t,-1,\n4,n,last,-1,2')
    return [str(tmp_path / "my_games.csv"), str(tmp_path / "reviews.csv"), str(tmp_path / "other.csv")]


def test_read_type_reject(spark, files):
    tables = sources.table_dispatch(spark, files)
    assert set(tables) == {"games", "reviews"}
    games = sources.typed_rows(tables["games"]).collect()
    assert len(games) == 1 and len(games[0]) == 40
    g = games[0]
    assert (g.name, g.windows, g.mac, g.linux, g.avg_playtime_two_weeks, len(g.categories), g.genres, g.tags) == ('A "b", c', True, False, True, 2.5, 4, ["Action", "Indie"], [""])
    assert [r.reason for r in sources.reject_rows(tables["games"]).collect()] == ["avg_playtime_forever"]
    assert {(r.app_id, r.review_text, r.review_score) for r in sources.typed_rows(tables["reviews"]).collect()} == {("1", 'two\nlines, "quoted"', 1), ("4", "last", -1)}
    assert {(r.app_id, r.reason) for r in sources.reject_rows(tables["reviews"]).collect()} == {("2", "review_score"), ("3", "review_votes")}


def test_results(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, 3, "j1"), ("b", 2.0, 4, "j2")], "name string, playtime double, n long, job_id string")
    out = str(tmp_path / "out")
    for _ in range(2):  # again: replaced, not added
        sources.write_results_csv(rows, out)
    got = sources.read_results_csv(spark, out, "name string, playtime string, n string, job_id string")
    assert sorted(map(tuple, got.collect())) == [("a", "1.500000", "3", "j1"), ("b", "2.000000", "4", "j2")]


def _field(rng):
    text = "".join(rng.choice('ab ,"\né') for _ in range(rng.randrange(14)))
    kind = rng.random()
    if kind < 0.6:
        return '"' + text.replace('"', '""') + '"'
    return 'x"y' if kind < 0.7 else "".join(c for c in text if c not in ',"\n').strip() or "z"


@pytest.mark.parametrize("size", [9, 60, 700])
def test_quoted_csv_in_ranges(spark, tmp_path, size):
    """Every border lies anywhere: in quotes, between doubled quotes, in the header, at a line's end."""
    rng = random.Random(size)
    paths = []
    for i in range(2):
        rows = [",".join(_field(rng) for _ in range(rng.choice([5, 5, 5, 4, 6]))) for _ in range(25 if size < 10 else 80)]
        paths.append(str(tmp_path / f"{i}.csv"))
        with open(paths[-1], "w") as f:
            f.write('h,"a\nbcdefghijklmnopq",c,d,e\n' + "\n".join(rows) + "\n" * i)
    want = spark.read.schema(sources.REVIEWS).options(header=True, quote='"', escape='"', multiLine=True, enforceSchema=True).csv(paths).na.fill("")
    want = sorted(map(repr, want.collect()))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sources.read_reviews(spark, paths)
        assert got.columns == sources.REVIEW_FIELDS
        assert sorted(map(repr, got.collect())) == want
        assert spark.read.text(paths).select("value").withColumn("p", quoted.F.spark_partition_id()).select("p").distinct().count() > 3
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_records_are_parsed_once(spark, files):
    """Filters on typed columns don't each parse the record anew."""
    typed = sources.typed_rows(sources.table_dispatch(spark, files)["games"])
    rows = typed.where((sources.F.size("genres") == 2) & sources.F.col("windows") & ~sources.F.col("mac"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_csv(") == 1
    assert rows.count() == 1


def _line_effect(line):
    def step(state, before):
        if state == 2:
            return 0
        return 2 if before.endswith(",") or (state == 0 and not before) else 1

    out, inside = 0, 2
    for before in line.split('"')[:-1]:
        out, inside = step(out, before), step(inside, before)
    return 2 * (inside == 2) + (out == 2)


def test_quotes_of_lines():
    rng = random.Random(5)
    lines = ["".join(rng.choice('a,"é') for _ in range(rng.randrange(20))) for _ in range(3000)] + ['"' * 1001, ""]
    got = quoted.line_effects(quoted.pa.array(lines))
    assert got.tolist() == [_line_effect(x) for x in lines]
    assert quoted.line_effects(quoted.pa.array(lines)[100:200]).tolist() == got[100:200].tolist()
    assert quoted.line_effects(quoted.pa.array([], quoted.pa.string())).tolist() == []


def test_records_go_on_in_the_next_batch(spark, tmp_path):
    want = [(str(i), "n", "x\n" * (i % 9) + '"', "1", "2") for i in range(60)]
    (tmp_path / "reviews.csv").write_text("a,b,c,d,e\n" + "".join(f'{a},{b},"{c.replace(chr(34), chr(34) * 2)}",{d},{e}\n' for a, b, c, d, e in want))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        got = [tuple(r) for r in sources.read_reviews(spark, str(tmp_path / "reviews.csv")).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert sorted(got) == sorted(want)


def test_quoted_csv_of_little(spark, tmp_path):
    (tmp_path / "reviews.csv").write_text("")
    (tmp_path / "more_reviews.csv").write_text("only,a,header,is,here")
    (tmp_path / "open_reviews.csv").write_text('a,b,c,d,e\n\n1,n,"never\nclosed,1,2\n')
    (tmp_path / "dos_reviews.csv").write_bytes(b'a,b,c,d,e\r\n2,n,"x\r\ny",1,2\r\n\r\n')

    def rows(name):
        return [tuple(r) for r in sources.read_reviews(spark, str(tmp_path / name)).collect()]

    assert rows("reviews.csv") == rows("more_reviews.csv") == []
    assert rows("open_reviews.csv") == [("1", "n", "never\nclosed,1,2", "", "")]
    assert [(r[0], r[2].replace("\r", ""), r[3], r[4]) for r in rows("dos_reviews.csv")] == [("2", "x\ny", "1", "2")]


def test_published_answers(spark, tmp_path):
    out, kind = str(tmp_path / "out"), "name string, playtime string"

    def answer(*rows):
        return spark.createDataFrame(list(rows), "job_id string, name string, playtime double")

    def read(job, query="q"):
        got = published.read_published(spark, out, job, query, kind)
        return got and sorted(map(tuple, got.collect()))

    published.publish({"q": answer(("a/b=1", "x", 1.5), ("j", "y", 2.0)), "p": answer(("j", "z", 0.0))}, out, ["a/b=1", "j"])
    assert (read("a/b=1"), read("j"), read("a/b=1", "p"), read("j", "p")) == ([("x", "1.500000")], [("y", "2.000000")], [], [("z", "0.000000")])
    assert read("other") is None and read("j", "r") is None

    # a writer that is killed half-way: rows are there, the manifest isn't
    def dies(*_):
        raise RuntimeError("killed")

    kept, published.store.write_new = published.store.write_new, dies
    try:
        with pytest.raises(RuntimeError):
            published.publish({"q": answer(("j", "new", 3.0))}, out, ["j"])
    finally:
        published.store.write_new = kept
    assert read("j") == [("y", "2.000000")]
    for i in range(4):
        published.publish({"q": answer(("j", f"new{i}", 3.0))}, out, ["j"])
        assert read("j") == [(f"new{i}", "3.000000")] and read("j", "p") == [("z", "0.000000")]
    assert read("a/b=1") == [("x", "1.500000")]
    left = [p for p in (tmp_path / "out" / "rows").glob("*/query=q/job_id=j")]
    assert len(left) == 3  # the last two, and the killed writer's


def test_two_publish_at_once(spark, tmp_path):
    """A number that another writer took first is not written over."""
    out = str(tmp_path)
    assert published.store.write_new(spark, f"{out}/m/0.json", "1") and not published.store.write_new(spark, f"{out}/m/0.json", "2")
    assert published.store.read_text(spark, f"{out}/m/0.json") == "1" and published.store.names(spark, f"{out}/m") == ["0.json"]


def test_scope_deletes_what_was_written(spark):
    from ludoscope.queries import QUERIES
    from ludoscope.scratch import scope, shared_dir, store, written

    before = store.names(spark, shared_dir(spark))
    with pytest.raises(ValueError), scope(spark):
        assert written(spark.range(3), "kept").count() == 3
        with scope(spark):
            assert QUERIES["stream_q3_keyed"](spark, "/root/testdata/sf0.001").count() == 5
            assert len(store.names(spark, shared_dir(spark))) > len(before) + 2
        assert len(store.names(spark, shared_dir(spark))) == len(before) + 1  # the outer table
        raise ValueError
    assert store.names(spark, shared_dir(spark)) == before
