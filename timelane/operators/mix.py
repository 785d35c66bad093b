"""Tracks, pairs and the weighted sum of many sample series.

``tracks``: mix, track, gain, pan, muted, solo. ``blocks``: mix, track, start (frame of
the first value), values (array of numbers); a track's blocks have one fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelane.functions.scalars import (
    audible,
    equal_power_pan,
    round_half_up,
)
from timelane.operators.keyframes import segments
from timelane.operators.ordered import Ordered, lists_per_key, ordered
from timelane.operators.sums import added_sums, weighted_sums

c = F.col


def any_solo(tracks: DataFrame) -> DataFrame:
    """Tracks with the mix-wide solo flag; aggregated first, so a large mix is no window."""
    flags = tracks.groupBy("mix").agg(F.bool_or("solo").alias("any_solo"))
    return tracks.join(flags, "mix")


def gated(tracks: DataFrame) -> DataFrame:
    """Adds ``any_solo`` and the gate, 1.0 or 0.0."""
    gate = F.when(audible(c("muted"), c("solo"), c("any_solo")), 1.0).otherwise(0.0)
    return any_solo(tracks).withColumn("gate", gate)


def positions(tracks: DataFrame, keys, order) -> DataFrame:
    """Stream index from 0, pair from 1 and side by load order: even left, odd right."""
    numbered = ordered(tracks, keys, order).scan(number="_n").df
    idx = c("_n") - 1
    return (
        numbered.withColumn("idx", idx)
        .withColumn("pair", F.floor(idx / 2) + 1)
        .withColumn("side", F.when(idx % 2 == 0, "L").otherwise("R"))
        .drop("_n")
    )


def pair_tracks(placed: DataFrame, keys, track: str) -> DataFrame:
    """One row per pair with its left and right track; the right may be missing."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return placed.groupBy(*keys, "pair").agg(
        F.max(F.when(c("side") == "L", c(track))).alias("left_track"),
        F.max(F.when(c("side") == "R", c(track))).alias("right_track"),
    )


def stereo_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sample rows (pair, frame, value) of both sides; a missing side is silent."""
    l = left.select("pair", "frame", c("value").alias("left_value"))
    r = right.select("pair", "frame", c("value").alias("right_value"))
    return l.join(r, ["pair", "frame"], "full_outer").select(
        "pair", "frame",
        F.coalesce("left_value", F.lit(0.0)).alias("left_value"),
        F.coalesce("right_value", F.lit(0.0)).alias("right_value"),
    )


def apply_targets(targets: DataFrame, automated: DataFrame) -> DataFrame:
    """Which pair drives each track: the last automated one in ``ord``."""
    live = targets.join(automated.select("mix", "pair").distinct(), ["mix", "pair"], "left_semi")
    return live.groupBy("mix", "track").agg(F.max_by("pair", "ord").alias("pair"))


def preview_mask(tracks: DataFrame, targets: DataFrame) -> DataFrame:
    """Mute every track outside the target set."""
    marked = targets.select("mix", "track").distinct().withColumn("_target", F.lit(True))
    return (
        tracks.join(marked, ["mix", "track"], "left")
        .withColumn("muted", c("_target").isNull())
        .drop("_target")
    )


def mute_all(tracks: DataFrame, baseline: DataFrame | None = None):
    """Everything muted, and the flags to restore; an existing baseline is kept."""
    if baseline is not None:
        return tracks, baseline
    return tracks.withColumn("muted", F.lit(True)), tracks.select("mix", "track", "muted")


def restore_baseline(tracks: DataFrame, baseline: DataFrame) -> DataFrame:
    """Stored mute flags for the tracks that still exist."""
    stored = baseline.select("mix", "track", c("muted").alias("_muted"))
    return (
        tracks.join(stored, ["mix", "track"], "left")
        .withColumn("muted", F.coalesce("_muted", "muted"))
        .drop("_muted")
    )


def set_pairs(placed: DataFrame, changes: DataFrame, keys="mix") -> DataFrame:
    """Write gain, spread or enabled of whole pairs; null fields stay."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ch = changes.select(
        *keys, "pair", *[c(x).alias(f"_{x}") for x in ("gain", "spread", "enabled")]
    )
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("_spread")))
    pan = F.when(c("side") == "L", -s).otherwise(s)
    return (
        placed.join(ch, [*keys, "pair"], "left")
        .withColumn("gain", F.coalesce("_gain", "gain"))
        .withColumn("pan", F.coalesce(F.when(c("_spread").isNotNull(), pan), c("pan")))
        .withColumn("muted", F.coalesce(~c("_enabled"), c("muted")))
        .drop("_gain", "_spread", "_enabled")
    )


def any_all_on(pairs: DataFrame, keys="mix") -> DataFrame:
    """``muted`` of each pair's reference track, null when unavailable."""
    counted = F.count("muted")
    return pairs.groupBy(keys).agg(
        F.coalesce(F.bool_or(~c("muted")), F.lit(False)).alias("any_on"),
        ((counted > 0) & F.coalesce(F.bool_and(~c("muted")), F.lit(False))).alias("all_on"),
    )


def mix_duration(tracks: DataFrame, keys="mix") -> DataFrame:
    return tracks.groupBy(keys).agg(
        F.greatest(F.lit(0.0), F.coalesce(F.max("duration"), F.lit(0.0))).alias("duration")
    )


def order_tracks(streams: DataFrame, tracks: DataFrame) -> DataFrame:
    """Stream order restricted to tracks that exist."""
    return streams.join(tracks.select("mix", "track"), ["mix", "track"], "left_semi").orderBy(
        "mix", "idx"
    )


def track_frames(blocks: DataFrame) -> DataFrame:
    """Length of each track, read from the blocks themselves."""
    return blocks.groupBy("mix", "track").agg(
        F.max(c("start") + F.size("values")).alias("frames")
    )


def _piece(low, high, t0=None, g0=None, t1=None, g1=None, easing="slider") -> Column:
    def double(x):
        return F.lit(None).cast("double") if x is None else x

    return F.struct(
        low.cast("bigint").alias("low"), high.cast("bigint").alias("high"),
        double(t0).alias("t0"), double(g0).alias("g0"), double(t1).alias("t1"),
        double(g1).alias("g1"),
        (easing if isinstance(easing, Column) else F.lit(easing)).alias("easing"),
    )


FAR = 1 << 60
TRACKS_IN_PART = 256
"""Tracks of one mix that are summed in one place."""


def gain_pieces(
    voices: DataFrame, keyframes: DataFrame | Ordered | None, rate: float, block_size: int
) -> DataFrame:
    """Gain over time of each voice, cut at keyframes and at block borders.

    ``voices``: mix, track, frames and anything to carry along. One row per (track, block,
    piece); ``low``..``high`` are frames, both included. There are at most as many rows as
    blocks and keyframes together, so the samples meet them in one equi-join on
    (mix, track, block), whatever the keyframes look like.
    """
    keys = ["mix", "track"]
    whole = _piece(F.lit(0), F.lit(FAR)).alias("p")
    if keyframes is None:
        pieces = voices.select("*", whole)
    else:
        t, g = c("time"), c("gain")

        def first_frame(x):
            return F.ceil(x * rate)

        before = _piece(F.lit(0), first_frame(t) - 1)
        inner = _piece(
            first_frame(t), first_frame(c("next_time")) - 1, t, g, c("next_time"),
            c("next_gain"), c("next_easing"),
        )
        last = F.floor(t * rate)
        point = _piece(first_frame(t), last, t, g, t, g, "hold")
        after = _piece(last + 1, F.lit(FAR))
        head = F.when(c("prev_time").isNull(), F.array(before)).otherwise(F.array())
        tail = F.when(c("next_time").isNull(), F.array(point, after)).otherwise(F.array(inner))
        cut = segments(keyframes, keys).select(*keys, F.explode(F.concat(head, tail)).alias("p"))
        joined = voices.join(cut, keys, "left")
        pieces = joined.withColumn("p", F.coalesce("p", whole))
    rows = (
        pieces.select(*voices.columns, "p.*")
        .withColumn("high", F.least(c("high"), c("frames") - 1))
        .where(c("high") >= c("low"))
    )
    low, high = F.floor(c("low") / block_size), F.floor(c("high") / block_size)
    return rows.select("*", F.explode(F.sequence(low, high)).alias("block"))


def mixdown(
    blocks: DataFrame, tracks: DataFrame, keyframes: DataFrame | Ordered | None = None, *,
    rate: float, block_size: int, master: float = 1.0, frames: DataFrame | None = None,
) -> DataFrame:
    """Stereo sum per (mix, frame) of the audible tracks.

    Each track is weighted by its gain (piecewise by its keyframes where it has some) and
    panned at equal power. Frames where nothing sounds are 0 up to the longest track. A block
    starts at a multiple of ``block_size`` and has at most so many values, else the run fails.

    Silent tracks are dropped on the small track table. Blocks and gain pieces are placed
    together by (mix, block), sorted there and summed as whole arrays, so no exchange holds a
    row per sample. A mix of more than TRACKS_IN_PART tracks is placed in several
    parts, whose sums (two arrays per mix, block and part) are added after a second exchange; samples
    become rows above it. ``frames`` (mix, track, frames) is what the catalogue knows of the
    lengths; without it the blocks are read once more to find them.
    """
    left, right = equal_power_pan(c("pan"))
    sized = gated(tracks).join(track_frames(blocks) if frames is None else frames, ["mix", "track"])
    longest = sized.groupBy("mix").agg(
        F.max_by("track", F.struct("frames", "track")).alias("_longest")
    )
    on = c("gate") > 0
    # The longest track stays even when silent: its zeros give the mix its length.
    voices = sized.join(longest, "mix").where(on | (c("track") == c("_longest"))).select(
        "mix", "track", "frames", c("gain").alias("slider"),
        F.coalesce(c("gate") * left, F.lit(0.0)).alias("l"),
        F.coalesce(c("gate") * right, F.lit(0.0)).alias("r"),
    )
    parts = _parts(tracks)
    mine = F.pmod(F.xxhash64("track"), F.coalesce("_parts", F.lit(1))).cast("int").alias("part")
    place = ["mix", "block", "part"]
    pieces = gain_pieces(voices, keyframes, rate, block_size).join(parts, "mix", "left").select(
        "mix", "block", mine, "track", F.lit(0).alias("kind"), "low", "high", "t0", "g0", "t1", "g1",
        "easing", c("slider").cast("double").alias("slider"), "l", "r",
    )
    samples = blocks.join(parts, "mix", "left").select(
        "mix", F.floor(c("start") / block_size).alias("block"), mine, "track", F.lit(1).alias("kind"),
        c("start").cast("bigint").alias("start"), c("values").cast("array<double>").alias("values"),
    )
    both = pieces.unionByName(samples, allowMissingColumns=True).repartition(*place)
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    sides = "left array<double>, right array<double>"
    by_part = both.sortWithinPartitions(*place, "track", "kind").mapInArrow(
        weighted_sums(block_size, float(rate), 3),
        ", ".join(f"{x} {kinds[x]}" for x in place) + f", {sides}",
    )
    whole = by_part.drop("part").repartition("mix", "block").sortWithinPartitions("mix", "block").mapInArrow(
        added_sums(block_size, 2), f"mix {kinds['mix']}, block {kinds['block']}, {sides}",
    )
    m = F.lit(float(master))
    rows = whole.select("mix", "block", F.posexplode(F.arrays_zip("left", "right")).alias("_pos", "_v"))
    return rows.where(c("_v.left").isNotNull()).select(
        "mix", (c("block") * block_size + c("_pos")).alias("frame"),
        (c("_v.left") * m).alias("left_value"), (c("_v.right") * m).alias("right_value"),
    )


def _parts(tracks: DataFrame) -> DataFrame:
    """Into how many parts a mix of many tracks is placed. Few rows whatever the data: one
    in TRACKS_IN_PART tracks at most, so they are broadcast."""
    counts = tracks.groupBy("mix").agg(F.count(F.lit(1)).alias("_tracks"))
    many = counts.where(c("_tracks") > TRACKS_IN_PART)
    return F.broadcast(many.select("mix", F.ceil(c("_tracks") / TRACKS_IN_PART).alias("_parts")))


def compact_state(placed: DataFrame, keys) -> DataFrame:
    """Per pair on-bit, gain and spread as integers, from the left track: one row per pair.

    ``placed``: keys, pair, side, track (null when missing), gain, pan, muted.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    left = F.when((c("side") == "L") & c("track").isNotNull(), F.struct("gain", "pan", "muted"))
    pairs = placed.groupBy(*keys, "pair").agg(F.max(left).alias("_left"))
    x = c("_left")
    return pairs.select(
        *keys, "pair",
        F.when(F.coalesce(~x["muted"], F.lit(True)), 1).otherwise(0).cast("bigint").alias("m"),
        round_half_up(F.coalesce(x["gain"], F.lit(1.0)) * 100).alias("g"),
        round_half_up(F.coalesce(F.abs(x["pan"]), F.lit(1.0)) * 100).alias("p"),
    )


def compact_lists(state: DataFrame, keys) -> DataFrame:
    """The arrays ``m``, ``g``, ``p`` of each mix, in pair order, as one saved text holds them.

    ``items`` is the number of pairs; see :func:`lists_per_key` for ``reason``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    lists = lists_per_key(state, keys, "pair", F.struct("m", "g", "p"), "_pairs")
    return lists.select(
        *keys, "items", *[c(f"_pairs.{x}").alias(x) for x in "mgp"], "reason"
    )


def snapshot(tracks: DataFrame, keys, order, fields) -> DataFrame:
    """The tracks of each key with their place, from 0, in the key's order."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    numbered = ordered(tracks, keys, order).scan(number="_n").df
    return numbered.select(*keys, (c("_n") - 1).alias("position"), *fields)
