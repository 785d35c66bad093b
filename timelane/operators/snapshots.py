"""Whole mixes: saved as one text each, applied again, and replayed from snapshots.

A mix is three tables. ``mixes``: mix, master, loop_start, loop_end. ``tracks``: mix, track, pair,
side, gain, pan, muted, solo. ``keyframes``: mix, pair, time, gain, easing, ord, in normal form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelane.functions.scalars import GAIN_MAX, GAIN_MIN, clamp
from timelane.operators.keyframes import normal_order, replay_snapshot
from timelane.operators.mix import compact_state
from timelane.operators.ordered import lists_per_key
from timelane.sources.state import apply_mix, state_json

c = F.col
TRACK_FIELDS = ("gain", "pan", "muted", "solo")


def saved_states(mixes: DataFrame, tracks: DataFrame, keyframes: DataFrame) -> DataFrame:
    """``mix`` and ``text``, the state of each mix with its automation as one JSON text.

    ``reason`` is set, with a null text, for a mix that no row can hold (see
    :func:`timelane.operators.ordered.lists_per_key`).
    """
    frame = F.struct("time", "gain", "easing")
    automation = lists_per_key(keyframes, ["mix", "pair"], ["time", "ord"], frame, "k").select(
        c("mix").alias("_mix"), c("pair").alias("_pair"), "k", c("reason").alias("_long"))
    rows = compact_state(tracks, "mix").join(
        automation, (c("mix") == c("_mix")) & (c("pair") == c("_pair")), "left")
    lists = lists_per_key(rows, "mix", "pair", F.struct("m", "g", "p", "k", "_long"), "s")
    text = state_json(c("s.m"), c("s.g"), c("s.p"), c("master") * 100, c("s.k"))
    reason = F.coalesce("reason", F.array_max("s._long"))
    return lists.join(mixes.select("mix", "master"), "mix").select(
        "mix", F.when(reason.isNull(), text).alias("text"), reason.alias("reason"))


def apply_saved(
    saved: DataFrame, mixes: DataFrame, tracks: DataFrame, keyframes: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mixes, tracks, keyframes) after the saved states were applied.

    ``saved``: mix, state (struct of ``decode_state``). Both tracks of a saved pair take its switch and
    gain, the left one the spread to the left and the right one to the right. All
    keyframes of a mix with a saved state go first; then those of the saved pairs that exist are set.
    Mixes without one stay as they are.
    """
    saved = saved.where(c("state").isNotNull())
    pairs = tracks.select("mix", "pair").distinct()
    settings = apply_mix(saved, pairs, "mix").select(
        c("mix").alias("_mix"), c("pair").alias("_pair"), c("enabled"), c("gain").alias("_gain"), "spread")
    met = tracks.join(settings, (c("mix") == c("_mix")) & (c("pair") == c("_pair")), "left")
    side = F.when(c("side") == "L", -c("spread")).otherwise(c("spread"))
    known = c("_mix").isNotNull()
    new = {
        "gain": clamp(c("_gain"), GAIN_MIN, GAIN_MAX), "pan": clamp(side, -1.0, 1.0), "muted": ~c("enabled"),
    }
    done = met.select(*[
        F.when(known, new[x]).otherwise(c(x)).alias(x) if x in new else c(x) for x in tracks.columns])
    master = clamp(c("state.master") / 100, GAIN_MIN, GAIN_MAX)
    masters = saved.select(c("mix").alias("_mix"), master.alias("_master"))
    mixed = mixes.join(masters, c("mix") == c("_mix"), "left").withColumn(
        "master", F.coalesce("_master", "master")).drop("_mix", "_master")
    frames = saved.select("mix", F.posexplode("state.automation").alias("_n", "_list")).select(
        "mix", (c("_n") + 1).cast("bigint").alias("pair"), F.posexplode("_list").alias("_at", "k"))
    present = frames.join(pairs, ["mix", "pair"], "left_semi").select(
        "mix", "pair", "k.time", "k.gain", "k.easing", c("_at").cast("bigint").alias("ord"))
    kept = keyframes.join(saved.select("mix"), "mix", "left_anti")
    return mixed, done, kept.select("mix", "pair", "time", "gain", "easing", "ord").unionByName(present)


def whole_snapshot(mixes: DataFrame, tracks: DataFrame, keyframes: DataFrame) -> DataFrame:
    """All of each mix as rows of one table: ``kind`` (mix, track or keyframe), ``position`` in
    its list, and the fields of that kind; those of the others are null."""
    listed = normal_order(keyframes, ["mix", "pair"]).scan(number="_n").df
    rows = mixes.select("mix", F.lit("mix").alias("kind"), "master", "loop_start", "loop_end")
    rows = rows.unionByName(tracks.select("mix", F.lit("track").alias("kind"), "track", *TRACK_FIELDS), True)
    return rows.unionByName(listed.select(
        "mix", F.lit("keyframe").alias("kind"), "pair", (c("_n") - 1).alias("position"), "time",
        c("gain").alias("frame_gain"), "easing"), True)


def replay_whole(
    snapshot: DataFrame, mixes: DataFrame, tracks: DataFrame, keyframes: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mixes, tracks, keyframes) with what :func:`whole_snapshot` stored put back.

    Tracks that still exist take the stored fields, the master gain comes back, and the keyframes of a
    stored mix are replaced as a whole, pairs the snapshot does not have included. The loop
    stays where it is now; mixes without a snapshot stay as they are.
    """
    heads = snapshot.where("kind = 'mix'").select(c("mix").alias("_mix"), c("master").alias("_master"))
    mixed = mixes.join(heads, c("mix") == c("_mix"), "left").withColumn(
        "master", F.when(c("_mix").isNotNull(), c("_master")).otherwise(c("master"))).drop("_mix", "_master")
    stored = snapshot.where("kind = 'track'").select("mix", "track", *TRACK_FIELDS)
    done = replay_snapshot(tracks, stored, ["mix", "track"], list(TRACK_FIELDS))
    frames = snapshot.where("kind = 'keyframe'").select(
        "mix", "pair", "time", c("frame_gain").alias("gain"), "easing", c("position").alias("ord"))
    kept = keyframes.join(heads.select(c("_mix").alias("mix")), "mix", "left_anti")
    return mixed, done.select(*tracks.columns), kept.select(*frames.columns).unionByName(frames)
