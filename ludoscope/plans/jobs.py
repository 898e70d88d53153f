"""Many jobs at once, each with its own parameters: a table of them, a row for each job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import array_contains_ci, extract_decade, polarity
from ..operators import filter_polarity, matched, rows_at_or_above_quantile, top_n
from ..scratch import written

FLAGS = ("windows", "linux", "mac")
#: The columns of the table of jobs, as :class:`plans.Params` has them.
PARAMS = "job_id long, top_category string, top_decade int, top_playtime int, top_reviews int, negative_category string, over long, percentile double"


def answers(games: DataFrame, reviews: DataFrame, jobs: DataFrame, language: Callable[[DataFrame], DataFrame], text: Sequence[str] = ("review_text",), job: str = "job_id") -> dict[str, DataFrame]:
    """The five answers of all jobs, under ``q1`` to ``q5``, each led by ``job``.

    ``games`` and ``reviews`` hold the rows of all jobs; ``language`` takes reviews (``text`` are
    the columns it needs) to those it accepts. Games meet their jobs' parameters once; reviews are
    counted once for all questions, and their texts are read for the negative reviews of the
    games that the fourth question asks about only. Jobs without games have zeros in ``q1`` and no
    rows elsewhere; rows of jobs that aren't in ``jobs`` are left out. Null jobs are a job."""
    wanted = [c.split()[0] for c in PARAMS.split(", ") if not c.startswith("job_id")]
    own = matched(games.select(job, "app_id", "name", "release_date", "avg_playtime_forever", "genres", *FLAGS), jobs.select(job, *wanted), [job])

    def of(category: str) -> Column:
        return array_contains_ci(F.col("genres"), F.col(category))

    marked = own.withColumns({"top": of("top_category"), "asked": of("negative_category"), "decade": extract_decade(F.col("release_date"))}).drop("genres", "release_date")
    g = written(marked, "jobs-games")

    flags = [F.coalesce(F.sum(F.col(f).cast("long")), F.lit(0)).alias(f) for f in FLAGS]
    none = jobs.select(job, *(F.lit(0).alias(f) for f in FLAGS))
    q1 = g.select(job, *(F.col(f).cast("int").alias(f) for f in FLAGS)).union(none).groupBy(job).agg(*flags)

    played = g.where(F.col("top") & (F.col("decade") == F.col("top_decade"))).withColumnRenamed("avg_playtime_forever", "avg_playtime")
    q2 = top_n(played, F.col("top_playtime"), [F.desc("avg_playtime"), F.asc("name"), F.asc("app_id")], [job]).select(job, "name", "avg_playtime")

    key = [job, "app_id"]
    signs = {s: F.count_if(polarity(F.col("review_score"), s == "positive")).alias(s) for s in ("positive", "negative")}
    counted = reviews.groupBy(*key).agg(*signs.values())
    about = g.where("asked").select(*key).distinct()
    negative = matched(filter_polarity(reviews, False).select(*key, "review_score", *text), about, key, "left_semi")
    spoken = language(negative).groupBy(*key).agg(F.count("*").alias("spoken"))
    known = matched(matched(g.where(F.col("top") | F.col("asked")), counted, key, "left"), spoken, key, "left")
    known = written(known.fillna(0, ["positive", "negative", "spoken"]), "jobs-counted")

    q3 = top_n(known.where("top"), F.col("top_reviews"), [F.desc("positive"), F.asc("name"), F.asc("app_id")], [job]).select(job, "name", F.col("positive").alias("n"))
    q4 = known.where(F.col("asked") & (F.col("spoken") > F.col("over"))).select(job, "name", F.col("spoken").alias("n"))
    some = known.where(F.col("asked") & (F.col("negative") > 0)).select(job, "percentile", "name", F.col("negative").alias("n"))
    q5 = rows_at_or_above_quantile(some, F.col("percentile"), by=[job, "percentile"]).select(job, "name", "n")
    return {"q1": q1, "q2": q2, "q3": q3, "q4": q4, "q5": q5}
