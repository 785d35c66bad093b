"""Peaks, levels and zones of sample blocks (mix, track, start, values)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelane.functions.scalars import level_bar, level_zone, pair_zone

c = F.col


def sample_rows(blocks: DataFrame, *keep: str) -> DataFrame:
    """One row per sample; the blocks are only unpacked, nothing moves."""
    return blocks.select(
        *keep, "start", F.posexplode("values").alias("_pos", "_v")
    ).select(*keep, (c("start") + c("_pos")).alias("frame"), c("_v").cast("double").alias("value"))


def waveform_peaks(
    blocks: DataFrame, bins: int, total_seconds=None, seconds=None, frames=None
) -> DataFrame:
    """Largest magnitude per bin; ``floor(n / bins)`` samples a bin, the rest is left out.

    With fewer samples than bins the bins past the end have peak 0. When the columns
    ``seconds`` (of the track) and ``total_seconds`` are given the track gets its share of
    the bins. ``frames`` (track, frames) is what the catalogue knows of the lengths;
    without it the blocks are read once more.

    The samples of a block become one maximum per bin before they leave their task, so the
    exchange by (track, bin) holds no samples.
    """
    share = F.lit(bins)
    source = blocks if frames is None else blocks.drop("values", "frames").join(frames, "track")
    size = c("start") + F.size("values") if frames is None else c("frames")
    aggs = [F.max(size).alias("_n")]
    if total_seconds is not None:
        aggs += [F.max(seconds).alias("_s"), F.max(total_seconds).alias("_t")]
        total = F.when(c("_t") > 0, c("_t")).otherwise(c("_s"))
        share = F.when(
            total > 0, F.greatest(F.lit(1), F.floor(c("_s") / total * bins))
        ).otherwise(F.lit(bins))
    if frames is not None and total_seconds is None:
        sizes = frames.select("track", c("frames").alias("_n"), share.cast("bigint").alias("_bins"))
    else:
        sizes = source.groupBy("track").agg(*aggs).select(
            "track", "_n", share.cast("bigint").alias("_bins")
        )
    per_bin = F.greatest(F.lit(1), F.floor(c("_n") / c("_bins")))
    sized = sizes.withColumn("_spb", per_bin)
    bin_of = F.floor(c("frame") / c("_spb"))
    found = (
        sample_rows(blocks.select("track", "start", "values").join(sized, "track"), "track", "_spb", "_bins")
        .withColumn("bin", bin_of).where(c("bin") < c("_bins"))
        .groupBy("track", "bin").agg(F.max(F.abs("value")).alias("peak"))
    )
    empty = sized.where(c("_n") < c("_bins")).select(
        "track", F.explode(F.sequence(c("_n"), c("_bins") - 1)).alias("bin"),
        F.lit(0.0).alias("peak"),
    )
    return found.unionByName(empty)


def level_window(blocks: DataFrame, window: int = 1024) -> DataFrame:
    """Peak and root mean square per track and window; a short last window counts as
    padded with silence."""
    return (
        sample_rows(blocks, "mix", "track")
        .groupBy("mix", "track", F.floor(c("frame") / window).alias("window"))
        .agg(
            F.max(F.abs("value")).alias("peak"),
            F.sqrt(F.sum(c("value") * c("value")) / window).alias("rms"),
        )
    )


def pair_level(levels: DataFrame, keys) -> DataFrame:
    """Larger of the two sides; a missing side counts as 0. Needs ``pair`` and ``peak``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    peak = F.greatest(F.lit(0.0), F.max("peak"))
    return levels.groupBy(*keys, "pair").agg(peak.alias("peak"))


def master_level(levels: DataFrame, keys) -> DataFrame:
    """Largest peak of the even (left) and odd (right) tracks. Needs ``idx`` and ``peak``."""
    keys = [keys] if isinstance(keys, str) else list(keys)

    def side(parity):
        picked = F.max(F.when(c("idx") % 2 == parity, c("peak")))
        return F.greatest(F.lit(0.0), picked)

    return levels.groupBy(*keys).agg(side(0).alias("left_peak"), side(1).alias("right_peak"))


def with_zones(levels: DataFrame) -> DataFrame:
    return levels.select(
        "*", level_bar(c("peak")).alias("bar"), level_zone(c("peak")).alias("zone"),
        pair_zone(c("peak")).alias("pair_zone"),
    )
