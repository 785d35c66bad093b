"""Windows of bytes that occur both in a scanned and in a target table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
WIDTH, STRIDE = 32, 8
MOST_HASHES = 2_000_000
"""Distinct target hashes (8 bytes each) that are sent to every task; with more of them the
scanned windows are joined by exchange instead."""


def windows(df: DataFrame, key: str, text: str, width: int, stride: int) -> DataFrame:
    """Hash and bytes of every window of the whole text. No shuffle; the text is only
    referenced by the unpacking, not copied into its rows."""
    data = c(text).cast("binary")
    sized = df.select(key, data.alias("_data")).where(F.length("_data") >= width)
    starts = F.sequence(F.lit(0), F.length("_data") - width, F.lit(stride))
    rows = sized.select(key, "_data", F.explode(starts).alias("offset"))
    piece = F.substring(c("_data"), c("offset") + 1, F.lit(width))
    return rows.select(
        key, c("offset").cast("bigint").alias("offset"), F.xxhash64(piece).alias("hash"),
        piece.alias("window"),
    )


def window_hash_search(
    scanned: DataFrame, targets: DataFrame, *, scan_key: str, target_key: str,
    scan_text: str = "text", target_text: str = "text", width: int = WIDTH, stride: int = STRIDE,
) -> DataFrame:
    """First place in each scanned text of a window that a target text holds.

    Targets are windowed at every byte, the scanned side at a stride, so each common run
    of ``width + stride - 1`` bytes is found. Scanned windows are cut down to those that
    occur in any target at all and to one row per (text, window) before targets are
    attached; equal hashes are confirmed on the bytes. Up to MOST_HASHES target hashes are
    looked up where the scanned text is read, so only windows with a known hash are exchanged.
    """
    wanted = windows(targets, target_key, target_text, width, 1).select(
        target_key, "hash", "window"
    ).distinct()
    any_target = wanted.select("hash", "window").distinct()
    scan = windows(scanned, scan_key, scan_text, width, stride)
    hashes = wanted.select("hash").distinct()
    if hashes.limit(MOST_HASHES + 1).count() <= MOST_HASHES:
        scan = scan.join(F.broadcast(hashes), "hash", "left_semi")
    hits = (
        scan
        .join(any_target, ["hash", "window"], "left_semi")
        .groupBy(scan_key, "hash", "window").agg(F.min("offset").alias("offset"))
    )
    return (
        hits.join(wanted, ["hash", "window"])
        .groupBy(scan_key, target_key)
        .agg(F.min("offset").alias("first_offset"), F.count(F.lit(1)).alias("windows"))
    )


def shared_windows(
    scanned: DataFrame, targets: DataFrame, *, scan_key: str, target_key: str,
    scan_text: str = "text", target_text: str = "text", width: int = WIDTH, stride: int = STRIDE,
) -> tuple[DataFrame, DataFrame]:
    """The windows that occur on both sides, each once, and which texts hold which.

    Classes: ``window``, ``scans`` and ``targets`` (how many texts of each side), ``first_scan`` and
    ``first_target`` (their least keys). Members: the scan key, ``window`` and the ``offset`` of its
    first place there. :func:`window_hash_search` gives the pairs of both; where very many texts
    share a window these two stay as long as the texts, and pairs of interest are joined from them.
    """
    wanted = windows(targets, target_key, target_text, width, 1).groupBy("hash", "window").agg(
        F.countDistinct(target_key).alias("targets"), F.min(target_key).alias("first_target"))
    scan = windows(scanned, scan_key, scan_text, width, stride)
    hashes = wanted.select("hash").distinct()
    if hashes.limit(MOST_HASHES + 1).count() <= MOST_HASHES:
        scan = scan.join(F.broadcast(hashes), "hash", "left_semi")
    held = scan.groupBy(scan_key, "hash", "window").agg(F.min("offset").alias("offset"))
    members = held.join(wanted.select("hash", "window"), ["hash", "window"], "left_semi")
    found = members.groupBy("hash", "window").agg(
        F.count(F.lit(1)).alias("scans"), F.min(scan_key).alias("first_scan"))
    classes = found.join(wanted, ["hash", "window"]).select(
        "window", "scans", "targets", "first_scan", "first_target")
    return classes, members.select(scan_key, "window", "offset")
