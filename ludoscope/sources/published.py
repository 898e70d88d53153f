"""Answers published by job and query, so that a reader sees a whole answer or the one before.

The rows of a publication lie under a name that no other has, as CSV without headers by query and
job. Each job has manifests, numbered: which publication its queries are to be read from. A job's
manifest is written when all its rows are there, as one file that appears whole; readers take the
last one. What neither of a job's last two manifests names is deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .. import store


def _name(spark: SparkSession, job: str, value) -> str:
    """The folder of a job, as Spark spells it."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return escape(job, None if value is None else str(value))


def _manifests(spark: SparkSession, folder: str, name: str) -> list[int]:
    return sorted(int(n[:-5]) for n in store.names(spark, f"{folder}/manifests/{name}") if n.endswith(".json"))


def _manifest(spark: SparkSession, folder: str, name: str, number: int) -> dict[str, list]:
    return json.loads(store.read_text(spark, f"{folder}/manifests/{name}/{number}.json"))


def publish(answers: Mapping[str, DataFrame], folder: str, jobs: Iterable, job: str = "job_id") -> None:
    """Writes the answers of ``jobs`` (a job without rows in one has an empty answer there),
    then their manifests. Other jobs' rows in ``answers`` aren't published, and queries that
    ``answers`` lacks stay as they were. Numbers are written as :func:`format_results` does."""
    from . import text_columns

    version, spark = uuid.uuid4().hex, None
    for query, rows in answers.items():
        spark = rows.sparkSession
        others = [c for c in rows.columns if c != job]
        rows.select(job, *text_columns(rows.select(*others))).write.partitionBy(job).option("header", False).csv(f"{folder}/rows/{version}/query={query}")
    if spark is None:
        return
    there = {q: set(store.names(spark, f"{folder}/rows/{version}/query={q}")) for q in answers}
    for value in jobs:
        name = _name(spark, job, value)
        new = {q: [version, name in there[q]] for q in answers}
        while True:  # another writer may take the number first
            own = _manifests(spark, folder, name)
            now = (_manifest(spark, folder, name, own[-1]) if own else {}) | new
            if store.write_new(spark, f"{folder}/manifests/{name}/{own[-1] + 1 if own else 0}.json", json.dumps(now)):
                break
        _prune(spark, folder, name)


def _prune(spark: SparkSession, folder: str, name: str) -> None:
    own = _manifests(spark, folder, name)
    kept = {(q, v) for n in own[-2:] for q, (v, _) in _manifest(spark, folder, name, n).items()}
    for n in own[:-2]:
        for q, (v, _) in _manifest(spark, folder, name, n).items():
            if (q, v) not in kept:
                store.delete(spark, f"{folder}/rows/{v}/query={q}/{name}")
        store.delete(spark, f"{folder}/manifests/{name}/{n}.json")


def read_published(spark: SparkSession, folder: str, value, query: str, schema: StructType | str, job: str = "job_id") -> DataFrame | None:
    """A job's last whole answer to a query; None if there is none yet."""
    name = _name(spark, job, value)
    own = _manifests(spark, folder, name)
    found = _manifest(spark, folder, name, own[-1]).get(query) if own else None
    if found is None:
        return None
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    version, any_rows = found
    rows = spark.read.schema(kind).option("header", False)
    return rows.csv(f"{folder}/rows/{version}/query={query}/{name}") if any_rows else spark.createDataFrame([], kind)
