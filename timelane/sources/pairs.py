"""Stereo pairs as one output per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelane.functions.scalars import quantize_pcm16
from timelane.functions.text import safe_name

c = F.col


def pair_name(pair, label):
    """``pair_<two digits>_<label>`` with the label made safe for a file name."""
    tag = safe_name(F.lower(label))
    number = pair.cast("string")
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return F.concat_ws("_", F.lit("pair"), padded, F.when(tag == "", "pair").otherwise(tag))


def named_pairs(stereo: DataFrame, labels: DataFrame) -> DataFrame:
    """Sample rows (pair, frame, left_value, right_value) with ``name`` and 16-bit values.

    Pairs without samples on either side have no rows and so no output.
    """
    named = stereo.join(labels.select("pair", "label"), "pair", "left")
    label = F.coalesce("label", F.lit("-"))
    return named.select(
        pair_name(c("pair"), label).alias("name"), "frame",
        quantize_pcm16(c("left_value")).cast("smallint").alias("left_pcm"),
        quantize_pcm16(c("right_value")).cast("smallint").alias("right_pcm"),
    )


def write_pairs(named: DataFrame, path: str) -> None:
    """A folder per pair. Rows are spread by range over (name, frame), so a long pair is
    written by several tasks, in order, and a task touches few folders."""
    (
        named.repartitionByRange("name", "frame").sortWithinPartitions("name", "frame")
        .write.mode("overwrite").partitionBy("name").parquet(path)
    )
