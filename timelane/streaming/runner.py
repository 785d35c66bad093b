"""Run a stream over the files that exist now and read its result back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from timelane.session import ROCKSDB, STATE_STORE, ensure_checkpoint_dir
from timelane.streaming.retention import _file_system, read_retained, retention_writer

FILE_ROWS = 100_000
"""Rows of a file that ``dripped`` writes; one task writes and one reads it."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint directory, which all executors see."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _run(spark: SparkSession, writer):
    """Start with the state store that processors need, and wait for the end of the input."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        running = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
    running.awaitTermination()
    return running


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Append-mode run to the end of the input; the emitted rows as a table."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    _run(spark, (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
    ))
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_upserts(stream: DataFrame, name: str, key, created: str, ord: str, keep: int = 1, owner=None) -> DataFrame:
    """Update-mode run to the end of the input: each emitted row replaces what its ``key`` had, and
    the newest ``keep`` rows of each ``owner`` (the key itself unless told otherwise) stay."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    write = retention_writer(f"{folder}/table", key, owner or key, created, ord, keep)
    _run(spark, (
        stream.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", f"{folder}/progress")
    ))
    return read_retained(spark, f"{folder}/table", stream.schema)


def late_rows(running) -> int:
    """Rows that a finished or running query dropped because they lay behind the watermark."""
    return sum(
        op["numRowsDroppedByWatermark"] for p in running.recentProgress for op in p["stateOperators"]
    )


def dripped(df: DataFrame, slice_of: F.Column, slices: int, name: str) -> DataFrame:
    """``df`` as a stream of ``slices`` micro-batches; ``slice_of`` numbers the slice of a row from 0.

    ``df`` is computed once and cut into folders. The slices are then written in turn, as files are
    read in the order of their times, each in the same number of files: a micro-batch takes that
    many. A slice with too few rows for all its files gets empty ones.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    cut, rows = f"{folder}/cut", f"{folder}/rows"
    df.withColumn("_slice", slice_of.cast("int")).write.partitionBy("_slice").parquet(cut)
    parts = spark.read.schema(StructType([*df.schema.fields, StructField("_slice", IntegerType())])).parquet(cut)
    parts = parts.where(F.col("_slice").between(0, slices - 1))
    most = parts.groupBy("_slice").count().agg(F.max("count")).first()[0] or 0
    files = max(1, -(-most // FILE_ROWS))
    for i in range(slices):
        part = parts.where(F.col("_slice") == i).drop("_slice")
        _append(part.repartition(files) if files > 1 else part.coalesce(1), rows)
        for _ in range((i + 1) * files - _parquet_files(spark, rows)):
            _append(spark.createDataFrame([], df.schema).coalesce(1), rows)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(rows)


def _append(df: DataFrame, folder: str) -> None:
    df.write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)


def _parquet_files(spark: SparkSession, folder: str) -> int:
    files, where = _file_system(spark, folder)
    return sum(e.getPath().getName().endswith(".parquet") for e in files.listStatus(where))
