"""Comparing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_diff(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has them more, with ``side``. All columns
    are compared as text without white space, whatever the order of rows."""

    def plain(rows: DataFrame) -> DataFrame:
        return rows.select(*(F.regexp_replace(F.col(c).cast("string"), r"\s", "").alias(c) for c in expected.columns))

    a, b = plain(expected), plain(got)
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionAll(b.exceptAll(a).withColumn("side", F.lit("extra")))


def result_merge(expected: DataFrame, got: DataFrame, key: str = "name", value: str = "n") -> DataFrame:
    """Rows of ``expected`` whose value ``got`` hasn't under the same key, with both values."""
    other = got.select(F.col(key), F.col(value).alias("got"))
    joined = expected.select(key, F.col(value).alias("expected")).join(other, key, "left")
    return joined.where(~F.col("expected").eqNullSafe(F.col("got")))
