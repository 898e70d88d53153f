"""Queries on the given tables, and SQL for the same rows.

Parts stand for games and line items for reviews (a return flag A is a score of 1, R of -1,
N of 0); orders are games with dates and playtimes; documents are reviews with a text, their
sources games; events are a log of messages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import operators as op
from . import plans, sources, store, streaming
from .operators import language, reconcile
from .plans import jobs
from .scratch import new_path
from .shipping import ship
from .sources import published
from .streaming import barrier, keyed, outbox

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("app_id"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("genres"), F.col("p_type"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("app_id"), score.alias("review_score"), "l_quantity", "l_orderkey")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("app_id"), F.col("o_orderkey").cast("string").alias("name"), F.split("o_orderpriority", "-").alias("genres"), F.date_format("o_orderdate", "MMM d, yyyy").alias("release_date"), F.col("o_totalprice").alias("avg_playtime_forever"), F.col("o_custkey"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", *((F.col("event_type") == x).alias(c) for c, x in (("windows", "click"), ("linux", "purchase"), ("mac", "error"))))


_SCORE = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END"
_DECADE = "coalesce(CAST(floor(year(try_strptime({0}, '%b %d, %Y')) / 10) * 10 AS INTEGER), 0)"
_DATE = "strftime(o_orderdate, '%b %d, %Y')"
_FLAGS = "SELECT event_id, user_id, CAST(event_type = 'click' AS BIGINT) AS windows, CAST(event_type = 'purchase' AS BIGINT) AS linux, CAST(event_type = 'error' AS BIGINT) AS mac FROM events"
_TOTALS = f"SELECT CAST(coalesce(sum(windows), 0) AS BIGINT) AS windows, CAST(coalesce(sum(linux), 0) AS BIGINT) AS linux, CAST(coalesce(sum(mac), 0) AS BIGINT) AS mac FROM ({_FLAGS})"
_COUNTED = "SELECT p_partkey AS app_id, p_name AS name, coalesce(c.n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE {0} GROUP BY 1) c ON l_partkey = p_partkey WHERE list_contains(string_split(lower(p_name), ' '), '{1}')"
_Q3 = f"SELECT name, n FROM ({_COUNTED.format(_SCORE + ' > 0', 'ring')}) ORDER BY n DESC, name, app_id LIMIT 5"
#: Rows at or above the percentile's value by row_number, where ours sums a histogram.
_AT_LEAST = "WITH c AS ({0}), r AS (SELECT *, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS m FROM c), v AS (SELECT coalesce(max(CASE WHEN i = CAST(floor(m * ({1} / 100.0::DOUBLE)) AS BIGINT) THEN n END), 0) AS value FROM r)"
_NEGATIVE = f"SELECT * FROM ({_COUNTED.format(_SCORE + ' < 0', 'ring')}) WHERE n > 0"

RING = plans.Params(top_category="Ring", negative_category="RING", top_reviews=5, percentile=90)
URGENT = plans.Params(top_category="Urgent", top_decade=1990, top_playtime=10)


# -- scalar functions and filters ---------------------------------------------------


@query("SELECT p_partkey, list_contains(string_split(lower(p_name), ' '), 'ring') AS has, list_contains(string_split(p_name, ' '), 'ring') AS has_exactly FROM part")
def array_contains_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", fn.array_contains_ci(names, "RiNG").alias("has"), fn.array_contains(names, "ring").alias("has_exactly"))


@query(f"SELECT o_orderkey, {_DECADE.format(_DATE)} AS decade, {_DECADE.format('o_orderpriority')} AS none FROM orders")
def extract_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", fn.extract_decade(F.date_format("o_orderdate", "MMM d, yyyy")).alias("decade"), fn.extract_decade(F.col("o_orderpriority")).alias("none"))


@query("SELECT event_id, event_type = 'click' AS flag FROM events")
def parse_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "click", "TRUE").when(F.col("event_type") == "view", "yes").when(F.col("event_type") == "error", "")
    return table(spark, sf_dir, "events").select("event_id", fn.parse_bool(text).alias("flag"))


@query("SELECT p_partkey, len(string_split(replace(p_name, ' ', ', '), ',')) AS n, string_split(replace(p_name, ' ', ', '), ',')[2] AS second FROM part")
def parse_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fn.parse_list(F.concat(F.lit('""'), F.regexp_replace("p_name", " ", ", "), F.lit('"')))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(got).cast("long").alias("n"), F.element_at(got, 2).alias("second"))


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS whole, CAST(NULL AS INTEGER) AS none, CAST(value AS DOUBLE) AS fraction FROM events")
def parse_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    whole = F.regexp_extract("props", "[0-9]+", 0)
    return e.select("event_id", fn.parse_int(whole).alias("whole"), fn.parse_int(F.concat(F.lit(" "), whole)).alias("none"), fn.parse_float(F.col("value").cast("string")).alias("fraction"))


@query(_FLAGS)
def flags_to_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(spark, sf_dir)
    return op.flags_to_counters(rows, ("windows", "linux", "mac"), "event_id").join(rows.select("event_id", "user_id"), "event_id").select("event_id", "user_id", *(F.col(c).cast("long").alias(c) for c in ("windows", "linux", "mac")))


@query("SELECT o_orderkey AS app_id, o_totalprice AS avg_playtime_forever FROM orders")
def project_playtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.map_filter(dated(spark, sf_dir), ["app_id", "avg_playtime_forever"])


@query("SELECT p_partkey AS app_id, p_name AS name FROM part")
def project_game_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.map_filter(games(spark, sf_dir), ["app_id", "name"])


@query("SELECT l_partkey AS app_id FROM lineitem")
def project_review_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.map_filter(reviews(spark, sf_dir), ["app_id"])


@query("SELECT p_partkey AS app_id, p_name AS name FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'ring')")
def filter_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_genre(games(spark, sf_dir), "Ring").select("app_id", "name")


@query(f"SELECT o_orderkey AS app_id FROM orders WHERE list_contains(string_split(lower(o_orderpriority), '-'), 'urgent') AND {_DECADE.format(_DATE)} = 1990")
def filter_genre_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_genre_decade(dated(spark, sf_dir), "urgent", 1990).select("app_id")


@query(f"SELECT sum(CASE WHEN {_SCORE} > 0 THEN 1 ELSE 0 END)::BIGINT AS positive, sum(CASE WHEN {_SCORE} < 0 THEN 1 ELSE 0 END)::BIGINT AS negative FROM lineitem")
def filter_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir)
    return r.agg(*(F.coalesce(F.count_if(fn.polarity(F.col("review_score"), x)), F.lit(0)).alias(c) for c, x in (("positive", True), ("negative", False))))


@query("SELECT p_partkey AS app_id, p_name AS name FROM part WHERE p_size > 25")
def map_filter_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter and a mapper given as callables on the table."""
    keep, columns = (lambda t: t.p_size > 25), (lambda t: [t.p_partkey.alias("app_id"), t.p_name.alias("name")])
    parts = table(spark, sf_dir, "part")
    return op.map_filter(parts, columns(parts), keep(parts))


@query(f"SELECT l_orderkey, l_partkey AS app_id FROM lineitem WHERE {_SCORE} > 0")
def map_filter_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.map_filter(reviews(spark, sf_dir), ["l_orderkey", "app_id"], fn.polarity(F.col("review_score"), True))


# -- joins and aggregates ---------------------------------------------------------------


_BUYERS = "SELECT c_custkey AS app_id, c_name AS name, coalesce(c.n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) c ON o_custkey = c_custkey"


def _buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as games, and their orders of a status as reviews of a polarity; some have none."""
    score = F.when(F.col("o_orderstatus") == "P", -1).otherwise(1)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("app_id"), score.alias("review_score"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("app_id"), F.col("c_name").alias("name"))
    return op.left_join_count(customers, op.filter_polarity(orders, False), "app_id", ["app_id", "name"])


@query(_BUYERS)
def left_join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buyers(spark, sf_dir)


@query(_TOTALS)
def flag_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.flag_totals(flagged(spark, sf_dir).withColumns({c: F.col(c).cast("int") for c in ("windows", "linux", "mac")}), ("windows", "linux", "mac"))


@query("SELECT l_partkey AS app_id, count(*) AS n FROM lineitem GROUP BY 1")
def count_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.count_by_key(reviews(spark, sf_dir), "app_id")


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.row_count(reviews(spark, sf_dir))


@query("SELECT event_type, CAST(sum(user_id) AS BIGINT) AS state FROM events GROUP BY 1")
def fold_state_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fold_state_sum(table(spark, sf_dir, "events"), "event_type", "user_id")


@query("SELECT event_type, arg_max(user_id, event_id) AS state FROM events GROUP BY 1")
def fold_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fold_state_latest(table(spark, sf_dir, "events"), "event_type", "user_id", ["ts", "event_id"])


@query("SELECT event_type, user_id, max(event_id) AS last_sequence FROM events GROUP BY 1, 2")
def last_sequence_per_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.last_sequence_per_origin(table(spark, sf_dir, "events"), "user_id", "event_id", by=("event_type",))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, those of errors sent twice: the copy right after the first."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.lit(0).alias("copy"))
    return e.union(e.where("event_type = 'error'").withColumn("copy", F.lit(1)))


@query("WITH m AS (SELECT event_id, event_type, ts, 0 AS copy FROM events UNION ALL SELECT event_id, event_type, ts, 1 FROM events WHERE event_type = 'error'), s AS (SELECT *, max(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m) SELECT event_id, event_type, copy FROM s WHERE event_id > coalesce(seen, -1)")
def dedup_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dedup_high_water(_log(spark, sf_dir), "event_type", "event_id", ["ts", "event_id", "copy"], F.date_trunc("hour", "ts")).select("event_id", "event_type", "copy")


# -- order, top, quantiles -----------------------------------------------------------------


@query("SELECT o_orderkey AS app_id, o_totalprice AS avg_playtime_forever FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n_playtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.top_n(dated(spark, sf_dir).select("app_id", "avg_playtime_forever"), 10, [F.desc("avg_playtime_forever"), F.asc("app_id")])


@query("SELECT l_partkey AS app_id, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, app_id LIMIT 5")
def top_n_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.top_n(op.count_by_key(reviews(spark, sf_dir), "app_id"), 5, [F.desc("n"), F.asc("app_id")])


@query("SELECT job_id, app_id, price FROM (SELECT o_custkey % 3 AS job_id, o_orderkey AS app_id, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 10")
def top_n_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dated(spark, sf_dir).select((F.col("o_custkey") % 3).alias("job_id"), "app_id", F.col("avg_playtime_forever").alias("price"))
    return op.top_n(rows, 10, [F.desc("price"), F.asc("app_id")], by=("job_id",))


@query(f"SELECT name, n FROM ({_COUNTED.format('true', 'ring')})")
def sort_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sort_by_count(op.left_join_count(op.filter_genre(games(spark, sf_dir), "ring"), reviews(spark, sf_dir), "app_id", ["app_id", "name"]), ties=("name", "app_id")).select("name", "n")


@query("SELECT l_partkey AS app_id, CAST(floor(count(*) * (90 / 100.0::DOUBLE)) AS BIGINT) AS place FROM lineitem GROUP BY 1")
def quantile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.count_by_key(reviews(spark, sf_dir), "app_id").select("app_id", fn.quantile_index(F.col("n"), 90).alias("place"))


@query(" UNION ALL ".join(f"(SELECT {p} AS percentile, value FROM (" + _AT_LEAST.format(_NEGATIVE, p) + " SELECT value FROM v))" for p in (0, 50, 90, 100)))
def quantile_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _negative(spark, sf_dir)
    one = [op.quantile_value(counted, p).select(F.lit(p).alias("percentile"), "value") for p in (0, 50, 90, 100)]
    return one[0].union(one[1]).union(one[2]).union(one[3])


def _negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.left_join_count(op.filter_genre(games(spark, sf_dir), "ring"), op.filter_polarity(reviews(spark, sf_dir), False), "app_id", ["app_id", "name"]).where("n > 0")


@query(_AT_LEAST.format(_NEGATIVE, 90) + " SELECT app_id, name, n FROM c, v WHERE n >= value")
def rows_at_or_above_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rows_at_or_above_quantile(_negative(spark, sf_dir), 90)


@query(f"SELECT name, n FROM ({_COUNTED.format(_SCORE + ' < 0', 'ring')}) WHERE n > 12")
def filter_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negative(spark, sf_dir).where(F.col("n") > 12).select("name", "n")


@query(f"SELECT app_id, name, n FROM ({_BUYERS}) WHERE n > 0")
def filter_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buyers(spark, sf_dir).where("n > 0")


@query(f"SELECT name, n FROM ({_NEGATIVE}) WHERE n >= 14")
def filter_at_least_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negative(spark, sf_dir).where(F.col("n") >= 14).select("name", "n")


# -- language --------------------------------------------------------------------------------

_TRI = "SELECT {0}, unnest(list_transform(range(1, greatest(length(lower(text)) - 1, 1)), lambda i: substr(lower(text), i, 3))) AS tri FROM documents"
_WEIGHTS = f"WITH c AS (SELECT tri, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang = 'es') AS b FROM ({_TRI.format('lang')} WHERE lang IN ('en', 'es')) GROUP BY 1), t AS (SELECT sum(a) AS na, sum(b) AS nb, count(*) AS v FROM c), w AS (SELECT tri, CAST(round(1000 * (ln((a + 1) / (na + v)::DOUBLE) - ln((b + 1) / (nb + v)::DOUBLE))) AS BIGINT) AS w FROM c, t)"
_SCORES = f"{_WEIGHTS}, s AS (SELECT doc_id, CAST(sum(w) AS BIGINT) AS score FROM ({_TRI.format('doc_id')}) JOIN w USING (tri) GROUP BY 1), l AS (SELECT doc_id, source, n_chars, CASE WHEN coalesce(score, 0) >= 2944 THEN 'en' WHEN coalesce(score, 0) <= -2944 THEN 'es' ELSE 'unknown' END AS language FROM documents LEFT JOIN s USING (doc_id))"


@query(f"SELECT tri, count(*) AS n FROM ({_TRI.format('doc_id')}) GROUP BY 1")
def lang_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.lang_ngrams(table(spark, sf_dir, "documents"), "doc_id").where("tri is not null").groupBy("tri").agg(F.sum("n").alias("n"))


@query(f"{_WEIGHTS} SELECT tri, w FROM w")
def lang_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.lang_train(table(spark, sf_dir, "documents"))


@query(f"{_SCORES} SELECT doc_id, language FROM l")
def lang_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.lang_score(docs, language.lang_train(docs), "doc_id").select("doc_id", language.label(F.col("score")).alias("language"))


@query(f"{_SCORES} SELECT doc_id FROM l WHERE language = 'en'")
def filter_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.filter_language(docs, language.lang_train(docs), "doc_id").select("doc_id")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("source").alias("app_id"), "doc_id", "text", F.when(F.col("n_chars") % 2 == 0, -1).otherwise(1).alias("review_score"))


def _english(docs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    weights = language.lang_train(docs)
    return lambda rows: language.filter_language(rows, weights, "doc_id")


@query(f"{_SCORES} SELECT doc_id FROM l WHERE language = 'en' AND n_chars % 2 = 0")
def filter_polarity_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op.filter_polarity_language(_texts(docs), False, _english(docs)).select("doc_id")


# -- the composite queries ----------------------------------------------------------------------


@query(_TOTALS)
def q1_platform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.q1_platform_counts(flagged(spark, sf_dir), key="event_id")


_Q2 = f"SELECT CAST(o_orderkey AS VARCHAR) AS name, o_totalprice AS avg_playtime FROM orders WHERE list_contains(string_split(lower(o_orderpriority), '-'), 'urgent') AND {_DECADE.format(_DATE)} = 1990 ORDER BY o_totalprice DESC, name, o_orderkey LIMIT 10"


@query(_Q2)
def q2_top_playtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.q2_top_playtime(dated(spark, sf_dir), URGENT)


@query(_Q3)
def q3_top_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.q3_top_positive(games(spark, sf_dir), reviews(spark, sf_dir), RING)


@query(f"{_SCORES} SELECT source AS name, count(*) AS n FROM l WHERE language = 'en' AND n_chars % 2 = 0 GROUP BY 1 HAVING count(*) > 20")
def q4_over_threshold_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = docs.select(F.col("source").alias("app_id")).distinct().select("app_id", F.col("app_id").alias("name"), F.array(F.lit("All")).alias("genres"))
    return plans.q4_over_threshold_language(named, _texts(docs), _english(docs), plans.Params(negative_category="all", over=20))


@query(_AT_LEAST.format(_NEGATIVE, 90) + " SELECT name, n FROM c, v WHERE n >= value")
def q5_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.q5_percentile(games(spark, sf_dir), reviews(spark, sf_dir), RING)


_JOB = "SELECT l_orderkey % 3 AS job_id, l_partkey, count(*) AS n FROM lineitem WHERE {0} GROUP BY 1, 2"
_JOBS = "SELECT j.job_id, p_partkey AS app_id, p_name AS name, coalesce(c.n, 0) AS n FROM part CROSS JOIN (SELECT DISTINCT l_orderkey % 3 AS job_id FROM lineitem) j LEFT JOIN ({0}) c ON l_partkey = p_partkey AND c.job_id = j.job_id WHERE list_contains(string_split(lower(p_name), ' '), 'ring')"


@query(f"WITH a AS ({_JOBS.format(_JOB.format(_SCORE + ' > 0'))}), b AS (SELECT * FROM ({_JOBS.format(_JOB.format(_SCORE + ' < 0'))}) WHERE n > 0), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY job_id) AS m FROM b), v AS (SELECT job_id, coalesce(max(CASE WHEN i = CAST(floor(m * (90 / 100.0::DOUBLE)) AS BIGINT) THEN n END), 0) AS value FROM r GROUP BY 1) SELECT 'q3' AS query, job_id, name, n FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, name, app_id) AS k FROM a) WHERE k <= 5 UNION ALL SELECT 'q5', job_id, name, n FROM b JOIN v USING (job_id) WHERE n >= value")
def multi_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three uploads of reviews for the same games, each with its own answers."""
    r = reviews(spark, sf_dir).withColumn("job_id", F.col("l_orderkey") % 3)
    g = games(spark, sf_dir).join(F.broadcast(r.select("job_id").distinct()))  # three rows
    q3 = plans.q3_top_positive(g, r, RING, by=("job_id",))
    q5 = plans.q5_percentile(g, r, RING, by=("job_id",))
    return q3.select(F.lit("q3").alias("query"), "job_id", "name", "n").union(q5.select(F.lit("q5").alias("query"), "job_id", "name", "n"))


_UPLOAD = f"""{_SCORES}, g AS (SELECT o_orderkey AS app_id, CAST(o_orderkey AS VARCHAR) AS name, {_DECADE.format(_DATE)} AS decade, o_orderstatus, o_totalprice FROM orders),
u AS (SELECT o_orderkey AS app_id, CAST(o_orderkey AS VARCHAR) AS name FROM orders WHERE list_contains(string_split(lower(o_orderpriority), '-'), 'urgent')),
r AS (SELECT doc_id // 8 AS app_id, n_chars % 2 = 0 AS negative, language FROM l),
n AS (SELECT app_id, name, count(r.negative) AS n FROM u JOIN r USING (app_id) WHERE negative GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS m FROM n),
v AS (SELECT coalesce(max(CASE WHEN i = CAST(floor(m * (90 / 100.0::DOUBLE)) AS BIGINT) THEN n END), 0) AS value FROM i)
SELECT 'q1' AS query, unnest(['windows', 'linux', 'mac']) AS name, unnest([count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'P')])::DOUBLE AS value FROM g
UNION ALL SELECT 'q2', name, avg_playtime FROM ({_Q2})
UNION ALL SELECT 'q3', name, CAST(n AS DOUBLE) FROM (SELECT u.app_id, name, count(r.app_id) AS n FROM u LEFT JOIN (SELECT * FROM r WHERE NOT negative) r USING (app_id) GROUP BY 1, 2 ORDER BY n DESC, name, 1 LIMIT 5)
UNION ALL SELECT 'q4', name, CAST(count(*) AS DOUBLE) FROM u JOIN r USING (app_id) WHERE negative AND language = 'en' GROUP BY u.app_id, name HAVING count(*) > 1
UNION ALL SELECT 'q5', name, CAST(n AS DOUBLE) FROM n, v WHERE n >= value"""


@query(_UPLOAD)
def run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five from one upload: orders are the games, with dates, playtimes, platforms (by
    status) and genres; documents are their reviews, eight for a game, with texts."""
    flags = {"windows": "O", "linux": "F", "mac": "P"}
    g = dated(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("app_id"), *((F.col("o_orderstatus") == x).alias(c) for c, x in flags.items())), "app_id")
    docs = table(spark, sf_dir, "documents")
    r = docs.select(F.expr("doc_id div 8").alias("app_id"), "doc_id", F.col("text").alias("review_text"), F.when(F.col("n_chars") % 2 == 0, -1).otherwise(1).alias("review_score"))
    weights = language.lang_train(docs)
    asked = plans.Params(top_category="Urgent", top_decade=1990, top_playtime=10, top_reviews=5, negative_category="Urgent", over=1, percentile=90)
    got = plans.run_all(g, r, lambda rows: language.filter_language(rows, weights, "doc_id", "review_text"), asked, key=("doc_id",))
    totals = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in flags)))
    q1 = got["q1"].select(totals.alias("x")).select(F.lit("q1").alias("query"), "x.*")
    q2 = got["q2"].select(F.lit("q2"), "name", "avg_playtime")
    rest = (got[q].select(F.lit(q), "name", F.col("n").cast("double")) for q in ("q3", "q4", "q5"))
    return reduce(DataFrame.union, rest, q1.union(q2))


#: Three jobs that ask for different things.
_ASKED = [(0, "Urgent", 1990, 3, 5, "Urgent", 0, 90.0), (1, "High", 1990, 10, 2, "HIGH", 1, 50.0), (2, "medium", 2000, 1, 4, "Medium", 0, 75.0)]
_PARAMS = ", ".join(c.split()[0] for c in jobs.PARAMS.split(", "))
_BY_JOB = f"""{_SCORES}, p AS (SELECT * FROM (VALUES {", ".join(map(str, _ASKED))}) AS p({_PARAMS})),
g AS (SELECT p.*, o_orderkey AS app_id, CAST(o_orderkey AS VARCHAR) AS name, {_DECADE.format(_DATE)} AS decade, o_orderstatus AS status, o_totalprice AS played, list_contains(string_split(lower(o_orderpriority), '-'), lower(top_category)) AS top, list_contains(string_split(lower(o_orderpriority), '-'), lower(negative_category)) AS asked FROM orders, p),
r AS (SELECT doc_id % 3 AS job_id, doc_id // 8 AS app_id, count(*) FILTER (n_chars % 2 = 1) AS positive, count(*) FILTER (n_chars % 2 = 0) AS negative, count(*) FILTER (n_chars % 2 = 0 AND language = 'en') AS spoken FROM l GROUP BY 1, 2),
h AS (SELECT g.*, coalesce(r.positive, 0) AS positive, coalesce(r.negative, 0) AS negative, coalesce(r.spoken, 0) AS spoken FROM g LEFT JOIN r USING (job_id, app_id)),
i AS (SELECT job_id, name, negative, percentile, row_number() OVER (PARTITION BY job_id ORDER BY negative) - 1 AS i, count(*) OVER (PARTITION BY job_id) AS m FROM h WHERE asked AND negative > 0),
v AS (SELECT job_id, coalesce(max(CASE WHEN i = CAST(floor(m * (percentile / 100.0::DOUBLE)) AS BIGINT) THEN negative END), 0) AS value FROM i GROUP BY 1)
SELECT job_id, 'q1' AS query, unnest(['windows', 'linux', 'mac']) AS name, unnest([count(*) FILTER (status = 'O'), count(*) FILTER (status = 'F'), count(*) FILTER (status = 'P')])::DOUBLE AS value FROM g GROUP BY 1
UNION ALL SELECT job_id, 'q2', name, played FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY played DESC, name, app_id) AS k FROM g WHERE top AND decade = top_decade) WHERE k <= top_playtime
UNION ALL SELECT job_id, 'q3', name, CAST(positive AS DOUBLE) FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY positive DESC, name, app_id) AS k FROM h WHERE top) WHERE k <= top_reviews
UNION ALL SELECT job_id, 'q4', name, CAST(spoken AS DOUBLE) FROM h WHERE asked AND spoken > over
UNION ALL SELECT job_id, 'q5', name, CAST(negative AS DOUBLE) FROM i JOIN v USING (job_id) WHERE negative >= value"""


def _job_answers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    asked = spark.createDataFrame(_ASKED, jobs.PARAMS)
    flags = {"windows": "O", "linux": "F", "mac": "P"}
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("app_id"), *((F.col("o_orderstatus") == x).alias(c) for c, x in flags.items()))
    g = dated(spark, sf_dir).join(o, "app_id").join(F.broadcast(asked.select("job_id")))  # three rows
    docs = table(spark, sf_dir, "documents")
    r = docs.select((F.col("doc_id") % 3).alias("job_id"), F.expr("doc_id div 8").alias("app_id"), "doc_id", F.col("text").alias("review_text"), F.when(F.col("n_chars") % 2 == 0, -1).otherwise(1).alias("review_score"))
    weights = language.lang_train(docs)
    return jobs.answers(g, r, asked, lambda rows: language.filter_language(rows, weights, "doc_id", "review_text"), ("doc_id", "review_text"))


def _as_one(got: dict[str, DataFrame]) -> DataFrame:
    totals = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in jobs.FLAGS)))
    q1 = got["q1"].select("job_id", totals.alias("x")).select("job_id", F.lit("q1").alias("query"), "x.*")
    q2 = got["q2"].select("job_id", F.lit("q2"), "name", F.col("avg_playtime").cast("double"))
    rest = (got[q].select("job_id", F.lit(q), "name", F.col("n").cast("double")) for q in ("q3", "q4", "q5"))
    return reduce(DataFrame.union, rest, q1.union(q2))


@query(_BY_JOB)
def job_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five answers for each of three jobs that ask with parameters of their own."""
    return _as_one(_job_answers(spark, sf_dir))


@query(_BY_JOB)
def publish_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same published by job and query, twice, and read back."""
    out, ids = new_path(spark, "published"), [a[0] for a in _ASKED]
    got = {q: rows.where("job_id is not null") for q, rows in _job_answers(spark, sf_dir).items()}
    published.publish({"q1": got["q1"].where("windows < 0")}, out, ids)  # replaced by the next
    published.publish(got, out, ids)
    kinds = {"q1": "windows long, linux long, mac long", "q2": "name string, avg_playtime double"}
    back = {q: [published.read_published(spark, out, j, q, kinds.get(q, "name string, n long")).withColumn("job_id", F.lit(j).cast("long")) for j in ids] for q in got}
    return _as_one({q: reduce(DataFrame.union, parts) for q, parts in back.items()})


# -- reconciliation, sources and sinks ------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS app_id, p_name AS name, 'missing' AS side FROM part WHERE p_size <= 10 UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, 'extra' FROM part WHERE p_size > 40")
def result_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("app_id"), F.translate("p_name", " ", "_").alias("name"), "p_size")
    diff = reconcile.result_diff(parts.where("p_size <= 40").drop("p_size"), parts.where("p_size > 10").drop("p_size").withColumn("name", F.concat("name", F.lit("\r"))))
    return diff.withColumn("name", F.translate("name", "_", " "))


@query("WITH a AS (SELECT l_partkey AS name, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS name, count(*) AS n FROM lineitem WHERE l_quantity < 45 GROUP BY 1) SELECT a.name, a.n AS expected, b.n AS got FROM a LEFT JOIN b USING (name) WHERE a.n IS DISTINCT FROM b.n")
def result_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).withColumnRenamed("app_id", "name")
    return reconcile.result_merge(op.count_by_key(r, "name"), op.count_by_key(r.where("l_quantity < 45"), "name"))


def _reviews_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a reviews file, some with a score that isn't a number, and read."""
    path = new_path(spark, "reviews") + "/reviews.csv"
    score = F.when(F.col("lang") == "fr", F.lit("n/a")).otherwise(F.when(F.col("n_chars") % 2 == 0, "-1").otherwise("1"))
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("app_id"), F.col("source").alias("app_name"), F.col("text").alias("review_text"), score.alias("review_score"), F.col("n_chars").cast("string").alias("review_votes"))
    text.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return sources.table_dispatch(spark, [path])["reviews"]


@query("SELECT CAST(doc_id AS VARCHAR) AS app_id, CAST(length(text) AS BIGINT) AS n, CAST(CASE WHEN n_chars % 2 = 0 THEN -1 ELSE 1 END AS INTEGER) AS review_score, CAST(n_chars AS INTEGER) AS review_votes FROM documents WHERE lang <> 'fr'")
def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.typed_rows(_reviews_csv(spark, sf_dir)).select("app_id", F.length("review_text").cast("long").alias("n"), "review_score", "review_votes")


@query("SELECT CAST(doc_id AS VARCHAR) AS app_id, 'review_score' AS reason FROM documents WHERE lang = 'fr'")
def reject_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.reject_rows(_reviews_csv(spark, sf_dir)).select("app_id", "reason")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS app_id, count(*) AS n FROM orders GROUP BY 1")
def read_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a games file of 40 fields, read and typed."""
    path = new_path(spark, "games") + "/games.csv"
    o = table(spark, sf_dir, "orders")
    given = {"app_id": F.col("o_orderkey").cast("string"), "name": F.concat(F.lit('a "quoted", name\n'), F.col("o_orderpriority")), "windows": F.lit("True"), "genres": F.translate("o_orderpriority", "-", ","), **{c: F.lit("0.5") for c in sources.DOUBLES}}
    o.select(*(given.get(c, F.lit("")).alias(c) for c in sources.GAME_FIELDS)).write.option("header", True).option("escape", '"').csv(path)
    typed = sources.typed_rows(sources.table_dispatch(spark, [path])["games"])
    return typed.where((F.size("genres") == 2) & F.col("windows") & ~F.col("mac") & F.col("name").startswith('a "quoted", name\n')).groupBy("app_id").agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS app_id, printf('%.6f', o_totalprice) AS price, CAST(o_custkey % 3 AS INTEGER) AS job_id FROM orders")
def write_results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "results")
    sources.write_results_csv(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("app_id"), F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 3).cast("int").alias("job_id")), path)
    return sources.read_results_csv(spark, path, "app_id string, price string, job_id int")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS app_id, printf('%.6f', o_totalprice) AS price FROM orders")
def format_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.format_results(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("app_id"), F.col("o_totalprice").alias("price")))


# -- streams -----------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # a pattern, since a stream's plain path must be a folder and a table may be a file
    return streaming.stream_ingest(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema, files=2)


@query(_TOTALS)
def stream_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events")
    flags = e.select(*((F.col("event_type") == x).cast("int").alias(c) for c, x in (("windows", "click"), ("linux", "purchase"), ("mac", "error"))))
    out = new_path(spark, "stream")
    streaming.until_inputs_end(streaming.stateful_flag_totals(flags, ("windows", "linux", "mac")), streaming.replace_result(out), f"{out}-checkpoint", "complete")
    return spark.read.parquet(out)


@query("SELECT o_orderkey AS app_id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def stream_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("app_id"), F.col("o_totalprice").alias("price"))
    out = new_path(spark, "stream")
    sink = streaming.stateful_top_n(out, 10, [F.desc("price"), F.asc("app_id")])
    last: list[int] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        last[:] = [batch_id]

    streaming.until_inputs_end(rows, each, f"{out}-checkpoint")
    return spark.read.parquet(f"{out}/{last[0]}")


@query(_Q3)
def stream_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of reviews counted, joined with the static games, and ranked at the end."""
    r = _stream(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("app_id"))
    out = new_path(spark, "stream")
    sink = streaming.static_join_count(op.filter_genre(games(spark, sf_dir), "ring"), "app_id", ["app_id", "name"], out)
    streaming.until_inputs_end(streaming.stateful_count(r, "app_id"), sink, f"{out}-checkpoint", "complete")
    return op.top_n(spark.read.parquet(out), 5, [F.desc("n"), F.asc("name"), F.asc("app_id")]).select("name", "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_dedup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, each sent twice, counted once by (origin, sequence); rows land in a sink that
    takes a batch again without harm."""
    e = _stream(spark, sf_dir, "events").select("event_type", "event_id")
    twice = e.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = new_path(spark, "stream")
    streaming.until_inputs_end(streaming.stream_dedup(twice, "event_type", "event_id").drop("copy"), streaming.idempotent_sink(out, ("event_type", "event_id")), f"{out}-checkpoint")
    return op.count_by_key(spark.read.parquet(out), "event_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the highest sequence of each origin."""
    e = _stream(spark, sf_dir, "events").select("event_type", "event_id")
    twice = e.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = new_path(spark, "stream")
    chunk = F.floor(F.col("event_id") / 4096)
    streaming.until_inputs_end(twice, streaming.stream_high_water(out, "event_type", "event_id", ["event_id", "copy"], chunk), f"{out}-checkpoint")
    return op.count_by_key(spark.read.parquet(f"{out}/rows"), "event_type")


@query(_Q3)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games and reviews as two streams at once, each into a sink of its own; the answer is
    given when both have ended."""
    out = new_path(spark, "stream")
    names = {"games": "part", "reviews": "lineitem"}
    streaming.until_all_end(*(streaming.start(_stream(spark, sf_dir, t), streaming.idempotent_sink(f"{out}/{c}"), f"{out}/{c}-checkpoint") for c, t in names.items()))
    g = spark.read.parquet(f"{out}/games").select(F.col("p_partkey").alias("app_id"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("genres"))
    r = spark.read.parquet(f"{out}/reviews").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("app_id"), F.lit(1).alias("review_score"))
    return plans.q3_top_positive(g, r, RING)


def _in_batches(rows: DataFrame, batches: int = 4) -> DataFrame:
    """The rows as a stream of so many batches, each of as many files as the rows have splits for."""
    path = new_path(rows.sparkSession, "batches")
    files = -(-rows.rdd.getNumPartitions() // batches)
    rows.repartition(batches * files).write.parquet(path)
    return streaming.stream_ingest(rows.sparkSession, path, rows.schema, files=files)


@query(_Q3)
def stream_q3_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of reviews in several batches; each writes the counts that it changed."""
    r = _in_batches(reviews(spark, sf_dir).where("review_score > 0").select("app_id"))
    out, own = new_path(spark, "stream"), op.filter_genre(games(spark, sf_dir), "ring")
    streaming.until_inputs_end(streaming.stateful_count(r, "app_id"), keyed.keyed_join_count(own, "app_id", ["app_id", "name"], out, 16), f"{out}-checkpoint", "update")
    counted = keyed.keyed_counts(own, "app_id", ["app_id", "name"], out, 16)
    return op.top_n(counted, 5, [F.desc("n"), F.asc("name"), F.asc("app_id")]).select("name", "n")


@query("SELECT l_partkey AS app_id, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, app_id LIMIT 5")
def stream_top_changing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest counts kept up while they change from batch to batch."""
    counts = streaming.stateful_count(_in_batches(reviews(spark, sf_dir).select("app_id")), "app_id")
    out = new_path(spark, "stream")
    top = keyed.MaintainedTop(spark, out, 5, counts.schema, "app_id")
    streaming.until_inputs_end(counts, top.each, f"{out}-checkpoint", "update")
    return top.read()


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_high_water_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, each sent twice, kept by the highest sequence of each origin, one number each."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id")
    out = new_path(spark, "stream")
    twice = streaming.stream_ingest(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema, files=1).select(*e.columns).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    streaming.until_inputs_end(twice, keyed.high_water(out, "event_type", "event_id", ["event_id", "copy"], F.floor(F.col("event_id") / 4096)), f"{out}-checkpoint")
    return op.count_by_key(spark.read.parquet(f"{out}/rows"), "event_type")


@query("SELECT place, app_id, price FROM (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey AS app_id, o_totalprice AS price FROM orders) WHERE place > 37")
def resume_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of an ordered result for a consumer that stopped after row 37."""
    rows = dated(spark, sf_dir).select("app_id", F.col("avg_playtime_forever").alias("price"))
    box = outbox.Outbox(spark, new_path(spark, "outbox"), rows.schema)
    box.fill(rows, [F.desc("price"), F.asc("app_id")])
    box.confirm(37)
    return box.pending()


@query(f"SELECT job_id, app_id, n FROM (SELECT l_orderkey % 3 AS job_id, l_partkey AS app_id, count(*) AS n FROM lineitem WHERE {_SCORE} > 0 GROUP BY 1, 2) WHERE job_id < 2")
def job_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three jobs in one stream of reviews, whose four origins each mark their end; one of
    job 2's never does, so that job has no answer."""
    r = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3).alias("job_id"), F.col("l_partkey").alias("app_id"), fn.polarity(F.when(F.col("l_returnflag") == "A", 1), True).alias("positive"))
    own = r.where("positive").select("job_id", F.lit("reviews").alias("table"), F.lit(None).cast("int").alias("origin"), "app_id", F.lit(False).alias("ends"))
    marks = spark.range(12).select((F.col("id") % 3).alias("job_id"), F.lit("reviews"), F.floor(F.col("id") / 3).cast("int").alias("origin"), F.lit(None).cast("long"), F.lit(True)).toDF(*own.columns).where("job_id < 2 OR origin < 3")
    path, out = new_path(spark, "batches"), new_path(spark, "barrier")
    for part in (own.where("job_id <> 1"), marks.where("job_id <> 1").coalesce(1), own.where("job_id = 1"), marks.where("job_id = 1").coalesce(1)):
        part.write.mode("append").parquet(path)  # markers, 11 rows, in one file each time
    n_files = sum(name.endswith(".parquet") for name in store.names(spark, path))
    stream = streaming.stream_ingest(spark, path, own.schema, files=-(-n_files // 4))  # four batches, in the order of writing

    def answer(rows: DataFrame, ended: DataFrame) -> None:
        published.publish({"q": op.count_by_key(rows, "app_id", by=("job_id",))}, out, [x[0] for x in ended.collect()])  # three jobs

    streaming.until_inputs_end(stream, barrier.answer_when_ended(f"{out}/state", F.col("ends"), {"reviews": 4}, answer), f"{out}-checkpoint")
    got = {j: published.read_published(spark, out, j, "q", "app_id long, n long") for j in range(3)}
    return reduce(DataFrame.union, (rows.select(F.lit(j).cast("long").alias("job_id"), "app_id", "n") for j, rows in got.items() if rows is not None))
