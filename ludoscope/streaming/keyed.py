"""Tables by key that micro-batches change in place, bucket by bucket.

A table's rows lie in buckets by the hash of their key. A batch writes anew only the buckets of the
keys that it changes, under its own number, and then a manifest: which number each bucket is
to be read under. Readers follow the last manifest, so they see a whole batch or none of it. A
batch that comes again starts from the manifest before it and gives the same files. Versions
that neither the last manifest nor the one before it names are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import store


class KeyedTable:
    """Rows by key at a path of the shared folder. All columns of ``key`` may be null."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], schema: StructType | str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    # -- manifests

    def batches(self) -> list[int]:
        """Numbers of the manifests that are there."""
        return sorted(int(n[:-5]) for n in store.names(self.spark, f"{self.path}/manifests") if n.endswith(".json"))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The batch under which each bucket is to be read, as of the last batch (below ``before``)."""
        own = [b for b in self.batches() if before is None or b < before]
        return {int(k): v for k, v in json.loads(store.read_text(self.spark, f"{self.path}/manifests/{own[-1]}.json")).items()} if own else {}

    # -- rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/batch={v}/bucket={b}" for b, v in sorted(manifest.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, before: int | None = None) -> DataFrame:
        """All rows as of the last batch, or as of the last before a number."""
        return self._rows(self.manifest(before))

    def change(self, batch_id: int, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replaces the buckets of the keys in ``changes``. ``merge`` gets those buckets' rows
        and the changes and gives the rows as they are to be; keys must stay in their bucket.
        ``changes`` is read twice, so it should be cached where it is costly."""
        before = self.manifest(batch_id)
        touched = sorted(r[0] for r in changes.select(self.bucket()).distinct().collect())  # buckets at most
        now = dict(before)
        if touched:
            old = self._rows({b: v for b, v in before.items() if b in set(touched)})
            new = merge(old, changes).select(*self.schema.names, self.bucket().alias("bucket"))
            target = f"{self.path}/rows/batch={batch_id}"
            new.repartition(len(touched), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(target)
            written = {int(n.split("=")[1]) for n in store.names(self.spark, target) if n.startswith("bucket=")}
            now = {b: v for b, v in now.items() if b not in touched} | dict.fromkeys(sorted(written), batch_id)
        if batch_id not in self.batches():
            store.write_new(self.spark, f"{self.path}/manifests/{batch_id}.json", json.dumps(now))
        self._prune()

    def _prune(self) -> None:
        """Deletes what only manifests before the last two name."""
        own = self.batches()
        for old in own[:-2]:
            store.delete(self.spark, f"{self.path}/manifests/{old}.json")
        named = {(v, b) for n in own[-2:] for b, v in json.loads(store.read_text(self.spark, f"{self.path}/manifests/{n}.json")).items()}
        for folder in store.names(self.spark, f"{self.path}/rows"):
            version = int(folder.split("=")[1])
            if own and version < own[-1]:
                kept = [f for f in store.names(self.spark, f"{self.path}/rows/{folder}") if f.startswith("bucket=")]
                for f in kept:
                    if (version, f.split("=")[1]) not in named:
                        store.delete(self.spark, f"{self.path}/rows/{folder}/{f}")
                if not any((version, f.split("=")[1]) in named for f in kept):
                    store.delete(self.spark, f"{self.path}/rows/{folder}")


def keyed_join_count(static: DataFrame, key: str, keep: Sequence[str], path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A sink for :func:`stateful_count` in update mode: every static row with its count so
    far, 0 if none. A batch brings the counts that it changed, and only their buckets are
    written. :func:`keyed_counts` reads the result."""
    table = _counts(static.sparkSession, static, key, keep, path, buckets)

    def each(counts: DataFrame, batch_id: int) -> None:
        counts = counts.select(key, F.col("n").cast("long").alias("n")).persist()
        try:
            if not table.manifest(batch_id):  # the first batch: the static rows, all of them
                rows = static.select(*table.schema.names[:-1], F.lit(0).cast("long").alias("n"))
                table.change(-1, rows, lambda _, new: new)
            table.change(batch_id, counts, _counted(key, table.schema.names[:-1]))
        finally:
            counts.unpersist()

    return each


def _counts(spark: SparkSession, static: DataFrame, key: str, keep: Sequence[str], path: str, buckets: int) -> KeyedTable:
    fields = list(dict.fromkeys([key, *keep]))
    return KeyedTable(spark, path, [key], static.select(*fields).schema.add("n", "long"), buckets)


def _counted(key: str, fields: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.withColumnRenamed("n", "__before").join(new, key, "left").select(*fields, F.coalesce("n", "__before").alias("n"))

    return merge


def keyed_counts(static: DataFrame, key: str, keep: Sequence[str], path: str, buckets: int = 64) -> DataFrame:
    """What :func:`keyed_join_count` has written."""
    return _counts(static.sparkSession, static, key, keep, path, buckets).read().select(*keep, "n")


def high_water(path: str, origin: str, sequence: str, arrival: Sequence[str], chunk: Column, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A sink of rows whose sequence is above all before of their origin, as
    :func:`stream_high_water`, with one number for each origin in a :class:`KeyedTable`: a
    batch writes only the buckets of the origins that got further. A busy origin's batch is
    spread by ``chunk``, and no task holds it. Rows go to ``path/rows``."""
    from ..operators import dedup_high_water

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"{path}/rows/batch={batch_id}"
        table = KeyedTable(spark, f"{path}/high", [origin], batch.select(origin, F.col(sequence).alias("__high")).schema, buckets)
        before = table.read(batch_id)
        fine = dedup_high_water(batch, origin, sequence, arrival, chunk)
        same = fine[origin].eqNullSafe(before[origin])
        fine.join(before, same, "left").where(F.col(sequence) > F.coalesce("__high", F.lit(-1))).select(*(fine[c] for c in batch.columns)).write.mode("overwrite").parquet(own)
        new = spark.read.schema(batch.schema).parquet(own).groupBy(origin).agg(F.max(sequence).alias("__high"))
        table.change(batch_id, new, lambda a, b: a.union(b).groupBy(origin).agg(F.max("__high").alias("__high")))

    return each


class MaintainedTop:
    """The first ``n`` of rows by key whose ``value`` (never null) changes, largest first, ties by ``ties``.

    Candidates are kept, at most ``slack`` times n after a batch, with a bound: no other row
    comes before it. A batch changes candidates, adds rows that come before the bound and, where they
    become too many, moves the bound up. If values fell so that fewer than n candidates are
    within the bound, they are chosen anew from all values: these lie as a log of what each
    batch brought. So a batch writes its own rows and the candidates; a repair reads the log.
    """

    def __init__(self, spark: SparkSession, path: str, n: int, schema: StructType | str, key: str, value: str = "n", ties: Sequence[str] = (), slack: int = 4) -> None:
        self.spark, self.path, self.n, self.key, self.value, self.slack = spark, path.rstrip("/"), n, key, value, slack
        self.ties = list(ties) or [key]
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.repairs = 0

    def _place(self) -> Column:
        """Smaller comes first."""
        return F.struct((-F.col(self.value)).alias("value"), *(F.col(t) for t in self.ties))

    def _best(self, rows: DataFrame, most: int) -> DataFrame:
        return rows.orderBy(self._place()).limit(most)

    def _state(self, batch_id: int) -> str:
        return f"{self.path}/candidates/batch={batch_id}"

    def _candidates(self, batch_id: int) -> DataFrame:
        """Rows, the last of which in order may be the bound: ``__bound`` marks it."""
        return self.spark.read.schema(StructType([*self.schema.fields]).add("__bound", "boolean")).parquet(self._state(batch_id))

    def _all(self, batch_id: int) -> DataFrame:
        """Every key's last values."""
        logged = [f"{self.path}/log/{name}" for name in store.names(self.spark, f"{self.path}/log") if name.startswith("batch=") and int(name[6:]) <= batch_id]
        log = self.spark.read.schema(self.schema).parquet(*logged).withColumn("__batch", F.regexp_extract("_metadata.file_path", "batch=([0-9]+)", 1).cast("long"))
        return log.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names), "__batch").alias("r")).select("r.*")

    def each(self, changes: DataFrame, batch_id: int) -> None:
        """The sink: a row for each key that changed, as it is now. A batch that comes again
        starts from the one before it."""
        names = self.schema.names
        changes.select(*names).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")
        changes = self.spark.read.schema(self.schema).parquet(f"{self.path}/log/batch={batch_id}")
        room = self.n * self.slack
        if batch_id:
            old = self._candidates(batch_id - 1)
            bound = old.where("__bound").select(self._place().alias("b")).first()
            kept = old.where("not __bound").drop("__bound").join(changes.select(self.key), self.key, "left_anti").select(*names)
            # within the bound: rows that may be among the first for sure
            within = kept.union(changes)
            if bound is not None:
                within = within.where(self._place() <= self._literal(bound["b"]))
            got = self._best(within, room + 1).collect()  # room + 1 rows
            if bound is not None and len(got) < self.n:
                self.repairs += 1
                got, bound = self._best(self._all(batch_id), room + 1).collect(), None
        else:
            got, bound = self._best(changes, room + 1).collect(), None
        if len(got) > room:  # the last one is the bound from now on
            rows = [(*r, False) for r in got[:room]] + [(*got[room], True)]
        elif bound is not None:
            rows = [(*r, False) for r in got] + [(*self._bound_row(batch_id - 1), True)]
        else:
            rows = [(*r, False) for r in got]
        schema = StructType([*self.schema.fields]).add("__bound", "boolean")
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(self._state(batch_id))
        for name in store.names(self.spark, f"{self.path}/candidates"):
            if int(name[6:]) < batch_id - 1:
                store.delete(self.spark, f"{self.path}/candidates/{name}")

    def _bound_row(self, batch_id: int):
        return self._candidates(batch_id).where("__bound").select(*self.schema.names).first()

    def _literal(self, place) -> Column:
        kinds = {f.name: f.dataType for f in self.schema.fields}
        parts = [F.lit(place["value"]).cast(kinds[self.value]).alias("value"), *(F.lit(place[t]).cast(kinds[t]).alias(t) for t in self.ties)]
        return F.struct(*parts)

    def read(self) -> DataFrame:
        """The first n as of the last batch."""
        own = [int(name[6:]) for name in store.names(self.spark, f"{self.path}/candidates") if name.startswith("batch=")]
        if not own:
            return self.spark.createDataFrame([], self.schema)
        return self._best(self._candidates(max(own)).where("not __bound").drop("__bound"), self.n)
