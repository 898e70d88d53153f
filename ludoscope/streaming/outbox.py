"""An ordered result that a consumer takes row by row, and goes on with where it stopped."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import store


class Outbox:
    """Rows of a result with places from 1, and the place up to which they are confirmed.

    Rows are dealt by ranges of the order and sorted, so no task has them all; a manifest, written
    last, says at which place each range begins. What is once filled stays as it is, so places
    are the same after a restart, and a filling that was cut off is begun anew."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _ranges(self) -> list[list[int]] | None:
        """Of each range: its part, the number of its first row, the rows before it, its rows."""
        return json.loads(store.read_text(self.spark, f"{self.path}/ranges.json")) if "ranges.json" in store.names(self.spark, self.path) else None

    def fill(self, rows: DataFrame, order: Sequence[str | Column]) -> None:
        """Writes the rows in an order, unless that was done; ties go by all columns."""
        if self._ranges() is not None:
            return
        total = [*order, *(F.col(c) for c in self.schema.names)]
        dealt = rows.select(*self.schema.names).repartitionByRange(*total).sortWithinPartitions(*total)
        dealt.withColumn("__row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.path}/rows")
        found = self._rows().groupBy(F.shiftrightunsigned("__row", 33).alias("part")).agg(F.min("__row").alias("first"), F.count("*").alias("n")).orderBy("part").collect()  # a row for each range
        ranges, before = [], 0
        for r in found:
            ranges.append([r["part"], r["first"], before, r["n"]])
            before += r["n"]
        store.write_new(self.spark, f"{self.path}/ranges.json", json.dumps(ranges))

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add("__row", "long")).parquet(f"{self.path}/rows")

    def confirmed(self) -> int:
        """The place of the last row that was confirmed, 0 before the first."""
        return max((int(n) for n in store.names(self.spark, f"{self.path}/confirmed") if n.isdigit()), default=0)

    def confirm(self, place: int) -> None:
        """Says that all rows up to a place have been taken."""
        before = [n for n in store.names(self.spark, f"{self.path}/confirmed") if n.isdigit()]
        store.write_new(self.spark, f"{self.path}/confirmed/{place:019d}", "")
        for n in before:
            if int(n) < place:
                store.delete(self.spark, f"{self.path}/confirmed/{n}")

    def pending(self) -> DataFrame:
        """``place`` and the rows that aren't confirmed, in no order; ranges before the
        confirmed place aren't read."""
        after = self.confirmed()
        left = [r for r in self._ranges() or [] if r[2] + r[3] > after]
        if not left:
            return self.spark.createDataFrame([], StructType().add("place", "long").add("__r", self.schema)).select("place", "__r.*")
        starts = self.spark.createDataFrame([(p, before - first + 1) for p, first, before, _ in left], "__part long, __shift long")
        rows = self._rows().where(F.col("__row") >= left[0][1] + max(after - left[0][2], 0))  # pushed to the files
        placed = rows.withColumn("__part", F.shiftrightunsigned("__row", 33)).join(starts, "__part")
        return placed.select((F.col("__row") + F.col("__shift")).alias("place"), *self.schema.names)

    def deliver(self, send: Callable[[Row], None], every: int = 1) -> None:
        """Gives the pending rows in order to ``send``, one range in memory at a time, and
        confirms each ``every`` rows. Of what was sent but not confirmed before a stop, at most
        ``every`` rows come again."""
        sent = 0
        for row in self.pending().orderBy("place").toLocalIterator():
            send(row)
            sent += 1
            if sent % every == 0:
                self.confirm(row["place"])
        if sent % every:
            self.confirm(row["place"])


def outbox_sink(path: str, order: Sequence[str | Column], send: Callable[[Row], None]) -> Callable[[DataFrame, int], None]:
    """A sink that delivers each batch's rows in order; a batch that was cut off goes on after
    the row that was confirmed last."""

    def each(batch: DataFrame, batch_id: int) -> None:
        box = Outbox(batch.sparkSession, f"{path}/batch={batch_id}", batch.schema)
        box.fill(batch, order)
        box.deliver(send)

    return each
