"""CSV sources with fixed schemas bound by position, a reject path, and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse_bool, parse_float, parse_int, parse_list
from . import quoted

#: Fixed layout of the two inputs, in the order of their fields.
GAME_FIELDS = (
    "app_id name release_date estimated_owners peak_ccu required_age price discount dlc_count about_the_game "
    "supported_languages full_audio_languages reviews header_image website support_url support_email windows mac linux "
    "metacritic_score metacritic_url user_score positive negative score_rank achievements recommendations notes "
    "avg_playtime_forever avg_playtime_two_weeks median_playtime_forever median_playtime_two_weeks "
    "developers publishers categories genres tags screenshots movies"
).split()
REVIEW_FIELDS = "app_id app_name review_text review_score review_votes".split()
FLAGS = ("windows", "mac", "linux")
DOUBLES = ("avg_playtime_forever", "avg_playtime_two_weeks", "median_playtime_forever", "median_playtime_two_weeks")
LISTS = ("developers", "publishers", "categories", "genres", "tags", "screenshots", "movies")
INTS = ("review_score", "review_votes")

GAMES = T.StructType([T.StructField(c, T.StringType()) for c in GAME_FIELDS])
REVIEWS = T.StructType([T.StructField(c, T.StringType()) for c in REVIEW_FIELDS])


def _read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Text columns of a CSV with a header line of any content; quoted fields may hold line
    breaks and doubled quotes. Empty fields, and those a short row lacks, are empty text. Many
    tasks read a file, which is gone through once, for its quotes, when this is called."""
    return quoted.read(spark, path, schema).na.fill("")


def read_games(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The 40 text columns of a games file."""
    return _read_csv(spark, path, GAMES)


def read_reviews(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The 5 text columns of a reviews file."""
    return _read_csv(spark, path, REVIEWS)


def table_dispatch(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Tables by what their file names contain: "games" or "reviews"; others are left alone."""
    readers = {"games": read_games, "reviews": read_reviews}
    found = {name: [p for p in paths if name in p.rsplit("/", 1)[-1]] for name in readers}
    return {name: readers[name](spark, own) for name, own in found.items() if own}


def _converted(columns: list[str]) -> dict[str, Column]:
    kinds = {**dict.fromkeys(FLAGS, parse_bool), **dict.fromkeys(DOUBLES, parse_float), **dict.fromkeys(LISTS, parse_list), **dict.fromkeys(INTS, parse_int)}
    return {c: kinds[c](F.col(c)) for c in columns if c in kinds}


def _reason(columns: list[str]) -> Column:
    """Names of the number columns whose text isn't a number; null if all are."""
    bad = [F.when(x.isNull(), F.lit(c)) for c, x in _converted(columns).items() if c in (*DOUBLES, *INTS)]
    return F.nullif(F.concat_ws(",", *bad), F.lit("")) if bad else F.lit(None).cast("string")


def typed_rows(rows: DataFrame) -> DataFrame:
    """Rows whose numbers all convert, with flags, numbers and lists as such."""
    return rows.where(_reason(rows.columns).isNull()).withColumns(_converted(rows.columns))


def reject_rows(rows: DataFrame) -> DataFrame:
    """The other rows as they are, with ``reason``: the columns that don't convert."""
    return rows.withColumn("reason", _reason(rows.columns)).where("reason is not null")


def text_columns(rows: DataFrame) -> list[Column]:
    """All columns as text: integers plainly, doubles with six decimals."""
    return [F.format_string("%f", c).alias(c) if kind in ("double", "float") else F.col(c).cast("string").alias(c) for c, kind in rows.dtypes]


def format_results(rows: DataFrame) -> DataFrame:
    """The rows as text, see :func:`text_columns`."""
    return rows.select(*text_columns(rows))


def write_results_csv(rows: DataFrame, folder: str, job: str = "job_id") -> None:
    """Header-less CSV files in a folder for each job; writing again replaces them.
    :func:`published.publish` replaces answers as wholes, by job and query."""
    rows.select(job, *text_columns(rows.drop(job))).write.partitionBy(job).option("header", False).mode("overwrite").csv(folder)


def read_results_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What :func:`write_results_csv` wrote; ``schema`` lists the columns, the job's last."""
    return spark.read.schema(schema).option("header", False).csv(folder)
