"""Streamed ingest with an answer when the inputs end. State and progress live in checkpoints,
so a stopped stream goes on where it was; sinks take a batch twice without harm."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import By, count_by_key, dedup_high_water, flag_totals, top_n


def stream_ingest(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files: int = 8, **options) -> DataFrame:
    """Files of a folder as they arrive, so many in a batch."""
    return spark.readStream.schema(schema).options(**options).option("maxFilesPerTrigger", files).format(kind).load(path)


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Starts ``each(batch, batch_id)`` on all that is there. With the same checkpoint a later
    call takes up what came since; a batch that was cut off comes again with its id."""
    return stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def until_all_end(*inputs: StreamingQuery) -> None:
    """Waits for all of several inputs that run at once; one that fails stops the others."""
    try:
        for query in inputs:
            query.awaitTermination()
    finally:
        for query in inputs:
            query.stop()


def until_inputs_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """One input, from start to end."""
    until_all_end(start(stream, each, checkpoint, mode))


def stateful_count(stream: DataFrame, key: str, by: By = ()) -> DataFrame:
    """Running counts for each key; write it in complete or update mode."""
    return count_by_key(stream, key, by=by)


def stateful_flag_totals(stream: DataFrame, flags: Sequence[str], by: By = ()) -> DataFrame:
    """Running sums of 0/1 columns."""
    return flag_totals(stream, flags, by)


def replace_result(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for complete results: each replaces the one before."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return each


def idempotent_sink(path: str, keys: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A sink for rows: each batch has a folder of its own, which the same batch replaces when
    it comes again; of rows with equal ``keys`` in a batch one stays."""

    def each(batch: DataFrame, batch_id: int) -> None:
        (batch.dropDuplicates(list(keys)) if keys else batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each


def stateful_top_n(path: str, n: int, order: Sequence[Column], by: By = ()) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the first n rows met so far: those of the last batch and this one
    together, in a folder for each batch, so a batch that comes again starts from the same."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id:
            rows = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/{batch_id - 1}"))
        top_n(rows, n, order, by).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return each


def static_join_count(static: DataFrame, key: str, keep: Sequence[str], path: str) -> Callable[[DataFrame, int], None]:
    """A sink for :func:`stateful_count` in complete mode: every static row with its count so
    far, 0 if none; Spark has no left join with a stream on the right."""

    def each(counts: DataFrame, batch_id: int) -> None:
        static.join(counts, key, "left").select(*keep, F.coalesce("n", F.lit(0)).alias("n")).write.mode("overwrite").parquet(path)

    return each


def stream_dedup(stream: DataFrame, origin: str = "origin", sequence: str = "sequence", by: By = ()) -> DataFrame:
    """Each (origin, sequence) once: enough where an origin's sequences only grow."""
    return stream.dropDuplicates([*by, origin, sequence])


def stream_high_water(path: str, origin: str, sequence: str, arrival: Sequence[str], chunk: Column) -> Callable[[DataFrame, int], None]:
    """A sink of rows whose sequence is above all before of their origin. Rows of a batch are
    taken in order of ``arrival``, by parts (``chunk``) of a busy origin; what earlier batches
    reached is a table of one row for each origin, written under each batch's number, so a
    batch that comes again starts from the same. Rows go to ``path/rows``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, high = batch.sparkSession, f"{path}/high"
        own = f"{path}/rows/batch={batch_id}"
        fine = dedup_high_water(batch, origin, sequence, arrival, chunk)
        schema = batch.select(origin, F.col(sequence).alias("__high")).schema
        before = spark.read.schema(schema).parquet(f"{high}/{batch_id - 1}") if batch_id else spark.createDataFrame([], schema)
        fine.join(before, origin, "left").where(F.col(sequence) > F.coalesce("__high", F.lit(-1))).select(*batch.columns).write.mode("overwrite").parquet(own)
        new = spark.read.schema(batch.schema).parquet(own).groupBy(origin).agg(F.max(sequence).alias("__high"))
        before.unionByName(new).groupBy(origin).agg(F.max("__high").alias("__high")).write.mode("overwrite").parquet(f"{high}/{batch_id}")

    return each
