"""Jobs that end one by one: a job is answered when all its end markers have come."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import store
from .keyed import KeyedTable

#: Gets all rows of the jobs that ended, and those jobs.
Answer = Callable[[DataFrame, DataFrame], None]
#: Rows of a job in a batch that one task writes, about.
IN_TASK = 1 << 17


def complete(markers: DataFrame, needed: Mapping[str, int], job: str = "job_id", table: str = "table") -> DataFrame:
    """Jobs with at least the needed number of distinct markers for each table."""
    enough = [(F.count_if(F.col(table) == t) >= n).alias(f"__{i}") for i, (t, n) in enumerate(needed.items())]
    told = markers.groupBy(job).agg(F.count("*").alias("__any"), *enough)
    return told.where(reduce(and_, (F.col(f"__{i}") for i in range(len(enough))), F.lit(True))).select(job)


def answer_when_ended(path: str, is_end: Column, needed: Mapping[str, int], answer: Answer, job: str = "job_id", table: str = "table", origin: str = "origin", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A sink for rows of many jobs. Rows where ``is_end`` holds are markers: a job ends when
    ``needed[t]`` origins have marked the end of each table t. One origin's marker counts once,
    however often it comes.

    Rows are kept by job and batch, a large job's by many tasks, markers in a :class:`KeyedTable`. ``answer`` is called in the
    batch that ends a job, once, with several if they end together; a batch that comes again
    calls it again with the same, so it should replace what it publishes. Rows that come after
    a job's end are kept but not answered."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"{path}/rows/__batch={batch_id}"
        batch = batch.persist()
        try:
            named = batch.where(~F.coalesce(is_end, F.lit(False))).withColumn("__job", _folder(job))
            _spread(named).write.partitionBy("__job").mode("overwrite").parquet(own)
            table_of = KeyedTable(spark, f"{path}/ends", [job], batch.select(job, table, origin).schema, buckets)
            new = batch.where(is_end).select(job, table, origin).distinct()
            before = complete(table_of.read(batch_id), needed, job, table)
            table_of.change(batch_id, new, lambda a, b: a.union(b).distinct())
            touched = new.select(job).distinct()
            now = complete(_of(table_of.read(batch_id + 1), touched, job), needed, job, table)
            ended = _of(now, before, job, "left_anti").persist()
            try:
                if not ended.isEmpty():
                    answer(_kept(spark, path, batch, batch_id, ended, job), ended)
            finally:
                ended.unpersist()
        finally:
            batch.unpersist()

    return each


def _of(rows: DataFrame, jobs: DataFrame, job: str, how: str = "left_semi") -> DataFrame:
    """Rows of the jobs, or of none of them; a null job is a job."""
    other = jobs.select(F.col(job).alias("__of"))
    return rows.join(other, rows[job].eqNullSafe(other["__of"]), how)


def _spread(named: DataFrame) -> DataFrame:
    """Rows dealt by ``__job``, so that a small job is in one file; those of a job of over
    ``IN_TASK`` rows in turn to as many tasks as it takes."""
    large = named.groupBy("__job").agg(F.count("*").alias("n")).where(F.col("n") > IN_TASK)
    parts = large.select("__job", F.ceil(F.col("n") / IN_TASK).alias("__parts"))  # fewer than rows / IN_TASK
    dealt = named.withColumn("__place", F.monotonically_increasing_id()).join(F.broadcast(parts), "__job", "left")
    return dealt.repartition("__job", F.pmod("__place", F.coalesce("__parts", F.lit(1)))).drop("__place", "__parts")


def _folder(job: str) -> Column:
    return F.coalesce(F.concat(F.lit("1"), F.col(job).cast("string")), F.lit("0"))


def _kept(spark: SparkSession, path: str, batch: DataFrame, batch_id: int, jobs: DataFrame, job: str) -> DataFrame:
    """The rows of some jobs in the batches up to one. The folders of others aren't read:
    Spark prunes partitions by the join."""
    names = [n for n in store.names(spark, f"{path}/rows") if n.startswith("__batch=") and int(n[8:]) <= batch_id]
    schema = StructType([*batch.schema.fields]).add("__job", "string").add("__batch", "long")
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/{n}" for n in names))
    return rows.join(jobs.select(_folder(job).alias("__job")), "__job", "left_semi").select(*batch.columns)
