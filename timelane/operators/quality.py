"""Rules, bounds and quarantine: bad rows keep a reason and never stop the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def between(column: str, low=None, high=None) -> Column:
    ok = c(column).isNotNull()
    if low is not None:
        ok = ok & (c(column) >= low)
    if high is not None:
        ok = ok & (c(column) <= high)
    return ok


def stream_rules() -> dict[str, Column]:
    # The ranges of the container records.
    return {
        "hash": between("hash", 0, 0x1FFFFFFF),
        "hash_hex": c("hash_hex").rlike("^0x[0-9a-f]{8}$"),
        "codec": c("codec").isin("pcm", "adpcm", "mp3", "unknown"),
        "codec_id": between("codec_id", 0, 0xFF),
        "sample_rate": between("sample_rate", 0, 0xFFFF),
        "sample_count": between("sample_count", 0),
        "duration_seconds": between("duration_seconds", 0),
    }


def validate_records(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``violations``, the names of the broken rules in rule order. One pass."""
    broken = [
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()
    ]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def bounds_check(df: DataFrame, offset: Column, size: Column, limit: Column) -> DataFrame:
    """Adds ``reason`` and ``at``; null reason inside the limit."""
    reason = (
        F.when((offset < 0) | (offset > limit), "offset_out_of_range")
        .when((size < 0) | (offset + size > limit), "size_past_end")
    )
    return df.withColumn("reason", reason).withColumn(
        "at", F.when(reason.isNotNull(), offset)
    )


def quarantine(df: DataFrame, reason: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with ``reason`` and ``at``."""
    marked = df.withColumn("reason", reason)
    good = marked.where(c("reason").isNull()).drop("reason")
    return good, marked.where(c("reason").isNotNull()).withColumn("at", at)


def supported_codec(df: DataFrame, codec: str = "codec") -> tuple[DataFrame, DataFrame]:
    """Decodable rows and rows with an error message."""
    ok = c(codec).isin("pcm", "mp3")
    message = F.concat(F.lit("unsupported codec "), c(codec))
    return df.where(ok), df.where(~ok).withColumn("message", message)


def needs_key(streams: DataFrame, keys) -> DataFrame:
    """Files with any encrypted stream."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return streams.groupBy(*keys).agg(F.bool_or("encrypted").alias("needs_key"))
