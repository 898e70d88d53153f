"""Operators on any tables: they take DataFrames and column names. ``by`` names columns, such
as a job's, that keep several uploads apart: they lead every group, join and ranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import array_contains_ci, extract_decade, polarity, quantile_index

By = Sequence[str]

#: Parts that the distinct values of a quantile are dealt into; one of them is looked through.
PARTS = 256


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of both sides, nulls equal, with the left side's keys; without keys each
    row meets each, for a side of one row."""
    if not keys:
        return left.join(right, how="cross")
    named = {k: f"__right{i}" for i, k in enumerate(keys)}
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(r)) for k, r in named.items()))
    return left.join(right.withColumnsRenamed(named), on, how).drop(*named.values())


# -- filters and projections ---------------------------------------------------


def map_filter(rows: DataFrame, columns: Sequence[str | Column], predicate: Column | None = None) -> DataFrame:
    """Rows that pass, projected; no predicate passes all. Spark pushes both to the scan."""
    return (rows if predicate is None else rows.where(predicate)).select(*columns)


def filter_genre(rows: DataFrame, category: str | Column, genres: str = "genres") -> DataFrame:
    """Rows of a category, whatever its case."""
    return rows.where(array_contains_ci(F.col(genres), category))


def filter_genre_decade(rows: DataFrame, category: str | Column, decade: int | Column, genres: str = "genres", date: str = "release_date") -> DataFrame:
    """Rows of a category and a decade."""
    return filter_genre(rows, category, genres).where(extract_decade(F.col(date)) == decade)


def filter_polarity(rows: DataFrame, positive: bool, score: str = "review_score") -> DataFrame:
    """Rows with a score above zero, or below zero."""
    return rows.where(polarity(F.col(score), positive))


def filter_polarity_language(rows: DataFrame, positive: bool, language, score: str = "review_score") -> DataFrame:
    """The same, and of a language; ``language`` takes the rows that are left to those it
    accepts, so the costly test sees few."""
    return language(filter_polarity(rows, positive, score))


def flags_to_counters(rows: DataFrame, flags: Sequence[str], key: str) -> DataFrame:
    """The key, and each flag as 0 or 1."""
    return rows.select(key, *(F.coalesce(F.col(f).cast("int"), F.lit(0)).alias(f) for f in flags))


# -- joins and aggregates --------------------------------------------------------


def count_by_key(rows: DataFrame, key: str, count: str = "n", by: By = ()) -> DataFrame:
    """Rows for each key."""
    return rows.groupBy(*by, key).agg(F.count("*").alias(count))


def left_join_count(left: DataFrame, right: DataFrame, key: str, keep: Sequence[str], count: str = "n", by: By = ()) -> DataFrame:
    """For each row of ``left``, how many rows of ``right`` have its key, 0 if none. The right
    side is counted before the join, so a popular key moves as one row."""
    counted = count_by_key(right, key, count, by)
    return left.join(counted, [*by, key], "left").select(*by, *keep, F.coalesce(count, F.lit(0)).alias(count))


def flag_totals(rows: DataFrame, flags: Sequence[str], by: By = ()) -> DataFrame:
    """The sum of each 0/1 column; without ``by`` always one row, zeros for no rows."""
    return rows.groupBy(*by).agg(*(F.coalesce(F.sum(F.col(f).cast("long")), F.lit(0)).alias(f) for f in flags))


def row_count(rows: DataFrame, by: By = ()) -> DataFrame:
    """The number of rows."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def fold_state_sum(log: DataFrame, key: str, delta: str, by: By = ()) -> DataFrame:
    """A log of changes replayed into totals."""
    return log.groupBy(*by, key).agg(F.coalesce(F.sum(delta), F.lit(0)).alias("state"))


def fold_state_latest(log: DataFrame, key: str, state: str, arrival: Sequence[str], by: By = ()) -> DataFrame:
    """A log of states replayed into the last one written."""
    return log.groupBy(*by, key).agg(F.max_by(state, F.struct(*arrival)).alias("state"))


def last_sequence_per_origin(log: DataFrame, origin: str = "origin", sequence: str = "sequence", by: By = ()) -> DataFrame:
    """The highest sequence of each origin; merging two such tables is this again on both."""
    return log.groupBy(*by, origin).agg(F.max(sequence).alias("last_sequence"))


def dedup_high_water(log: DataFrame, origin: str, sequence: str, arrival: Sequence[str], chunk: Column, by: By = ()) -> DataFrame:
    """Messages whose sequence is above all that came before from their origin.

    ``chunk`` is a coarse part of the arrival order, such as the hour: what came before is
    the highest of earlier chunks, from a small table, and of earlier rows in the chunk, so
    the rows of one busy origin are spread over as many tasks as it has chunks. Null origins
    and chunks are an origin and a chunk.
    """
    rows = log.withColumn("__chunk", chunk)
    keys = [*by, origin]
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    highest = rows.groupBy(*keys, "__chunk").agg(F.max(sequence).alias("__high")).select(*keys, "__chunk", F.max("__high").over(earlier).alias("__before"))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    marked = matched(rows.withColumn("__inside", F.max(sequence).over(inside)), highest, [*keys, "__chunk"])
    seen = F.coalesce(F.greatest("__before", "__inside"), F.lit(-1))
    return marked.where(F.col(sequence) > seen).select(*log.columns)


# -- order, top, quantiles --------------------------------------------------------


def top_n(rows: DataFrame, n: int | Column, order: Sequence[Column], by: By = ()) -> DataFrame:
    """The first n rows in an order, which should break ties; all if they are fewer. Each
    task keeps n rows of its own before any move. With ``by``, n may be a column."""
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def sort_by_count(rows: DataFrame, count: str = "n", ties: Sequence[str] = ("name",)) -> DataFrame:
    """All rows in ascending order of a count."""
    return rows.orderBy(count, *ties)


def quantile_value(rows: DataFrame, percentile: float | Column, count: str = "n", by: By = ()) -> DataFrame:
    """``value``: the count at the percentile's place in ascending order, 0 if the place is
    past the end. A percentile may be one of the columns in ``by``.

    Rows are summed up by count. The distinct counts, which may be as many as the rows, are dealt
    by ranges between their approximate quantiles; the rows in each range tell in which one the
    place is, and only that one is sorted, so no task gets all rows or all counts."""
    hist = rows.groupBy(*by, count).agg(F.count("*").alias("__rows"))
    bounds = hist.groupBy(*by).agg(F.percentile_approx(count, [i / PARTS for i in range(1, PARTS)], 10_000).alias("__bounds"), F.sum("__rows").alias("__all"))
    part = F.coalesce(F.size(F.filter("__bounds", lambda b: b < F.col(count))), F.lit(0))
    dealt = matched(hist, bounds if by else F.broadcast(bounds), by).select(*by, count, "__rows", part.alias("__part"), quantile_index(F.col("__all"), percentile).alias("__place"))  # one row is broadcast
    sums = dealt.groupBy(*by, "__part", "__place").agg(F.sum("__rows").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = sums.withColumn("__before", before).where(F.col("__place").between(F.col("__before"), F.col("__before") + F.col("__n") - 1)).select(*by, "__part", "__before")
    upto = F.col("__before") + F.sum("__rows").over(Window.partitionBy(*by, "__part").orderBy(count).rowsBetween(Window.unboundedPreceding, 0))
    found = matched(dealt, chosen, [*by, "__part"]).select(*by, count, "__place", upto.alias("__upto")).where(F.col("__upto") > F.col("__place")).select(*by, F.col(count).alias("value"))
    if by:  # groups whose place is past the end
        found = found.union(bounds.select(*by, F.lit(None).cast(hist.schema[count].dataType).alias("value")))
    return found.groupBy(*by).agg(F.coalesce(F.min("value"), F.lit(0)).alias("value"))


def rows_at_or_above_quantile(rows: DataFrame, percentile: float | Column, count: str = "n", by: By = ()) -> DataFrame:
    """Rows whose count is at least the percentile's value, ties at the cut included."""
    value = quantile_value(rows, percentile, count, by)
    if by:
        return matched(rows, value, by).where(F.col(count) >= F.col("value")).drop("value")
    one = F.lit(1).alias("__one")
    return rows.select("*", one).join(F.broadcast(value.select("value", one)), "__one").where(F.col(count) >= F.col("value")).drop("value", "__one")  # one row is broadcast
