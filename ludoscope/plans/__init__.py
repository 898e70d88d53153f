"""The five composite queries. All are lazy and take typed tables; ``by`` keeps jobs apart."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filter_genre, filter_genre_decade, filter_polarity, filter_polarity_language, flag_totals, flags_to_counters, left_join_count, map_filter, rows_at_or_above_quantile, sort_by_count, top_n
from ..scratch import written


@dataclass(frozen=True)
class Params:
    """What the queries are asked with."""

    top_category: str = "indie"
    top_decade: int = 2010
    top_playtime: int = 10
    top_reviews: int = 5
    negative_category: str = "action"
    over: int = 5000
    percentile: float = 90


def q1_platform_counts(games: DataFrame, key: str = "app_id", flags: Sequence[str] = ("windows", "linux", "mac"), by: Sequence[str] = ()) -> DataFrame:
    """How many games each platform has."""
    return flag_totals(flags_to_counters(games, flags, key) if not by else games, flags, by)


def q2_top_playtime(games: DataFrame, p: Params = Params(), playtime: str = "avg_playtime_forever", by: Sequence[str] = ()) -> DataFrame:
    """The most played games of a category and decade, ties by name and key."""
    own = filter_genre_decade(games, p.top_category, p.top_decade).select(*by, "app_id", "name", F.col(playtime).alias("avg_playtime"))
    return top_n(own, p.top_playtime, [F.desc("avg_playtime"), F.asc("name"), F.asc("app_id")], by).select(*by, "name", "avg_playtime")


def _counted(games: DataFrame, reviews: DataFrame, category: str, by: Sequence[str]) -> DataFrame:
    own = map_filter(filter_genre(games, category), [*by, "app_id", "name"])
    return left_join_count(own, map_filter(reviews, [*by, "app_id"]), "app_id", ["app_id", "name"], by=by)


def q3_top_positive(games: DataFrame, reviews: DataFrame, p: Params = Params(), by: Sequence[str] = ()) -> DataFrame:
    """Games of a category with the most positive reviews, ties by name and key."""
    counted = _counted(games, filter_polarity(reviews, True), p.top_category, by)
    return top_n(counted, p.top_reviews, [F.desc("n"), F.asc("name"), F.asc("app_id")], by).select(*by, "name", "n")


def q4_over_threshold_language(games: DataFrame, reviews: DataFrame, language: Callable[[DataFrame], DataFrame], p: Params = Params(), by: Sequence[str] = ()) -> DataFrame:
    """Games of a category with more than so many negative reviews in a language."""
    counted = _counted(games, filter_polarity_language(reviews, False, language), p.negative_category, by)
    return counted.where(F.col("n") > p.over).select(*by, "name", "n")


def q5_percentile(games: DataFrame, reviews: DataFrame, p: Params = Params(), by: Sequence[str] = ()) -> DataFrame:
    """Games of a category whose number of negative reviews, if any, is at or above a percentile."""
    counted = _counted(games, filter_polarity(reviews, False), p.negative_category, by).where("n > 0")
    return sort_by_count(rows_at_or_above_quantile(counted, p.percentile, by=by), ties=("name", "app_id")).select(*by, "name", "n")


def run_all(games: DataFrame, reviews: DataFrame, language: Callable[[DataFrame], DataFrame], p: Params = Params(), by: Sequence[str] = (), key: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All five over one read of each input: both are written as columns in the shared folder,
    pruned to what the queries and ``language`` (``key``) use, and each query then reads its
    own columns only."""
    games = written(games.select(*by, "app_id", "name", "release_date", "windows", "linux", "mac", "avg_playtime_forever", "genres"), "games")
    reviews = written(reviews.select(*by, "app_id", "review_text", "review_score", *key), "reviews")
    return {
        "q1": q1_platform_counts(games, by=by),
        "q2": q2_top_playtime(games, p, by=by),
        "q3": q3_top_positive(games, reviews, p, by),
        "q4": q4_over_threshold_language(games, reviews, language, p, by),
        "q5": q5_percentile(games, reviews, p, by),
    }
