"""Display strings, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timelane.functions.scalars import SILENT_GAIN, round_half_up

KIB = 1024
MIB = 1024 * 1024
GIB = 1024 * 1024 * 1024


def _int(x: Column) -> Column:
    return x.cast("bigint").cast("string")


def _two(x: Column) -> Column:
    return F.lpad(_int(x), 2, "0")


def _finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def to_fixed(x: Column, places: int) -> Column:
    """``x`` with a fixed number of decimals, rounded on its exact binary value.

    Halves go away from zero. ``format_string`` rounds the printed decimal instead, which
    differs for values like 1.005. The product with the scale is taken together with its
    rounding error, so the decision at a half is exact.
    """
    size = F.abs(x.cast("double"))
    scale = 10**places
    twice = float(2 * scale)
    spread = size * 134217729.0
    high = spread - (spread - size)
    product = size * twice
    error = (high * twice - product) + (size - high) * twice
    near = F.floor((product + 1.0) / 2.0)
    on_half = (product == F.floor(product)) & (product % 2.0 == 1.0) & (error < 0)
    n = (near - F.when(on_half, 1).otherwise(0)).cast("bigint")
    whole = F.floor(n / scale).cast("bigint").cast("string")
    rest = F.lpad((n % scale).cast("string"), places, "0")
    sign = F.when(x < 0, "-").otherwise("")
    return F.concat(sign, whole, F.lit("."), rest) if places else F.concat(sign, whole)


def gain_db(gain: Column) -> Column:
    """Decibels with one decimal and a plus sign from 0 up; minus infinity when silent."""
    db = 20.0 * F.log10(F.when(gain > SILENT_GAIN, gain))
    return (
        F.when(gain <= SILENT_GAIN, F.lit("-∞"))
        .when(db >= 0, F.concat(F.lit("+"), to_fixed(db, 1)))
        .otherwise(to_fixed(db, 1))
    )


def gain_percent(gain: Column) -> Column:
    return F.concat(_int(round_half_up(gain * 100)), F.lit("%"))


def format_bytes(n: Column) -> Column:
    x = n.cast("double")
    return (
        F.when(n < KIB, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < MIB, F.concat(to_fixed(x / KIB, 1), F.lit(" KiB")))
        .when(n < GIB, F.concat(to_fixed(x / MIB, 1), F.lit(" MiB")))
        .otherwise(F.concat(to_fixed(x / GIB, 2), F.lit(" GiB")))
    )


def format_megabytes(n: Column) -> Column:
    return F.concat(to_fixed(n.cast("double") / MIB, 1), F.lit(" MB"))


def format_duration(seconds: Column, mode: str = "listing") -> Column:
    """Minutes and seconds.

    ``listing``: rounded, ``-`` for null, endless or not positive. ``short``: floored,
    ``-`` for negative. ``readout``: floored, negative counts as 0. ``precise``: two
    decimals, negative counts as 0.
    """
    s = seconds.cast("double")
    ok = _finite(s)
    if mode == "listing":
        whole = round_half_up(s)
        text = F.concat(_int(F.floor(whole / 60)), F.lit(":"), _two(whole % 60))
        return F.when(ok & (s > 0), text).otherwise(F.lit("-"))
    if mode == "short":
        text = F.concat(_int(F.floor(s / 60)), F.lit(":"), _two(F.floor(s % 60)))
        return F.when(ok & (s >= 0), text).otherwise(F.lit("-"))
    z = F.when(ok & (s >= 0), s).otherwise(F.lit(0.0))
    minutes = F.concat(_int(F.floor(z / 60)), F.lit(":"))
    if mode == "readout":
        return F.concat(minutes, _two(F.floor(z % 60)))
    if mode == "precise":
        return F.concat(minutes, F.lpad(to_fixed(z % 60, 2), 5, "0"))
    raise ValueError(f"unknown mode {mode}")


def format_age(milliseconds: Column) -> Column:
    ms = milliseconds.cast("double")
    minutes = F.floor(ms / 60_000)
    hours = F.floor(minutes / 60)
    return (
        F.when(~_finite(ms) | (ms < 0) | (minutes < 1), F.lit("just now"))
        .when(minutes < 60, F.concat(_int(minutes), F.lit("m ago")))
        .when(hours < 24, F.concat(_int(hours), F.lit("h ago")))
        .otherwise(F.concat(_int(F.floor(hours / 24)), F.lit("d ago")))
    )


def safe_name(text: Column) -> Column:
    joined = F.regexp_replace(text, "(?i)[^a-z0-9._+-]+", "_")
    return F.regexp_replace(joined, "^_+|_+$", "")


def strip_extension(name: Column, suffix: str, fallback: str | None = None) -> Column:
    """Drop a literal suffix, any case; the fallback replaces an empty rest."""
    out = F.regexp_replace(name, "(?i)\\Q" + suffix + "\\E$", "")
    if fallback is None:
        return out
    return F.when(out == "", F.lit(fallback)).otherwise(out)


def path_parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def path_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def classify_file(name: Column, kinds: dict[str, str]) -> Column:
    """Kind by suffix, any case; null when no suffix fits."""
    lower = F.lower(name)
    out = F.when(F.lit(False), F.lit(""))
    for suffix, kind in kinds.items():
        out = out.when(lower.endswith(suffix), F.lit(kind))
    return out


def parse_number(text: Column) -> Column:
    """The leading decimal number of a trimmed text; null when there is none."""
    digits = F.regexp_extract(
        F.trim(text), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1
    )
    value = F.when(digits != "", digits.try_cast("double"))
    return F.when(_finite(value), value)


def pair_key_index(key: Column) -> Column:
    """Number in ``pair-<n>``; null for any other key."""
    return F.regexp_extract(key, r"^pair-(\d+)$", 1).try_cast("bigint")
