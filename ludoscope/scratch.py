"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from . import store

_made: list[str] = []
_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside is deleted at the end, also after a failure.
    Results are lazy and read those tables, so they are to be consumed inside too."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            store.delete(spark, path)
            store.delete(spark, f"{path}-checkpoint")  # a stream's, beside what it wrote


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it isn't set, and one machine does all the work, a
    temporary folder that goes when the process ends."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="ludoscope-"))
        atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
    return f"file://{_made[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it belongs to the innermost open scope."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows read back from a table in the shared folder: computed once, and not again
    when an executor is lost."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
