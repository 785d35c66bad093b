"""Tables written between the steps of a job, so that lost executors never repeat the whole."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from timelane.session import scratch_path

_gathering: list[list[str]] = []


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession)
    for paths in _gathering:
        paths.append(path)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


@contextmanager
def gathered(paths: list[str]) -> Iterator[None]:
    """Note the folders that :func:`stored` makes meanwhile in ``paths``."""
    _gathering.append(paths)
    try:
        yield
    finally:
        _gathering.remove(paths)


def release(paths: list[str], still_read: DataFrame) -> None:
    """Delete the folders of ``paths`` that ``still_read`` does not read, and take them off the list."""
    if not paths:
        return
    spark = still_read.sparkSession
    used = {name.rsplit("/", 1)[0].rsplit("/step-")[-1].split("/")[0] for name in still_read.inputFiles()}
    for path in [p for p in paths if p.rsplit("/step-")[-1] not in used]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        paths.remove(path)


MOST_IDS = 2_000_000
"""Ids (8 bytes each) that are sent to every task; with more, rows and ids meet by exchange."""


def small_ids(ids: DataFrame) -> DataFrame:
    """``ids`` stored and counted, marked for a broadcast where they are few enough."""
    from pyspark.sql import functions as F

    ids = stored(ids)
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids
