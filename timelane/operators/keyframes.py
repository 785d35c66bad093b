"""Keyed keyframe tables: normal form, envelopes at given times, and edits.

A keyframe table has key columns and ``time`` (double seconds), ``gain`` (double),
``easing`` (``linear`` or ``hold``) and ``ord`` (bigint, the input order of a key).
Normal form: finite values, times from 0, gains inside the bounds, sorted, no two rows
of a key closer than ``SAME_TIME``. Indexes (``idx``) count from 0 in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelane.functions.scalars import (
    GAIN_MAX,
    GAIN_MIN,
    clamp,
    envelope_value,
    round_half_up,
)
from timelane.operators.ordered import Ordered, biggest, lists_per_key, ordered

SAME_TIME = 1e-9
MOVED_TIME = 1e-6
AT_ZERO = 0.001
FADE_OUT_SECONDS = 2.0
DUPLICATE_SECONDS = 1.0
FIELDS = ("time", "gain", "easing", "ord")

c = F.col


def is_finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def drop_non_finite(df: DataFrame) -> DataFrame:
    return df.where(is_finite(c("time")) & is_finite(c("gain")))


def clean(df: DataFrame) -> DataFrame:
    return (
        drop_non_finite(df)
        .withColumn("time", F.greatest(F.lit(0.0), c("time")))
        .withColumn("gain", clamp(c("gain"), GAIN_MIN, GAIN_MAX))
        .withColumn("easing", F.when(c("easing") == "hold", "hold").otherwise("linear"))
    )


def dedupe_last(data: Ordered) -> Ordered:
    """Of rows closer than ``SAME_TIME`` to the one before, keep the last."""
    marked = data.scan(lead={"_next": c("time")})
    apart = c("_next").isNull() | (c("_next") - c("time") >= SAME_TIME)
    return marked.map(lambda d: d.where(apart).drop("_next"))


def normal_order(df: DataFrame, keys, order=("time", "ord"), bound: int | None = None) -> Ordered:
    """Normal form, still ordered: operators below take it in place of a plain table and
    need not count or sort its rows again."""
    return dedupe_last(ordered(clean(df), keys, order, bound=bound))


def normalize_keyframes(df: DataFrame, keys) -> DataFrame:
    return normal_order(df, keys).df


def indexed(data: Ordered) -> Ordered:
    return data.scan(number="_n").map(
        lambda d: d.withColumn("idx", c("_n") - 1).drop("_n")
    )


def renumber(df: DataFrame, keys) -> DataFrame:
    """Normal form with ``idx``."""
    return indexed(normal_order(df, keys)).df


def segments(keyframes: DataFrame | Ordered, keys) -> DataFrame:
    """Every keyframe with its neighbours; null at the ends."""
    return _neighbours(ordered(keyframes, keys, ["time", "ord"])).df


def _neighbours(data: Ordered) -> Ordered:
    return data.scan(
        lag={"prev_time": c("time"), "prev_gain": c("gain")},
        lead={"next_time": c("time"), "next_gain": c("gain"), "next_easing": c("easing")},
    )


def fill_hold(keyframes: DataFrame | Ordered, keys) -> DataFrame:
    """Gain of the latest hold keyframe up to each row."""
    held = F.when(c("easing") == "hold", c("gain"))
    return ordered(keyframes, keys, ["time", "ord"]).scan(fill={"held": held}).df


def time_extent(keyframes: DataFrame, keys) -> DataFrame:
    return keyframes.groupBy(*_list(keys)).agg(
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        (F.count(F.lit(1)) > 0).alias("has_automation"),
    )


def envelope_at(
    probes: DataFrame, keyframes: DataFrame | Ordered, keys, at: str = "at"
) -> DataFrame:
    """Envelope of each probe's key at the probe's time.

    Adds ``envelope`` (first or last gain outside the range, null without keyframes) and
    ``inside`` (the time lies between the first and the last keyframe, both included).
    Probes and segments are sorted together once, so no pair of them is compared.
    ``keyframes`` must be in normal form.
    """
    keys = _list(keys)
    frames = ordered(keyframes, keys, ["time", "ord"])
    seg = _neighbours(frames).df
    here = F.struct(
        c("time").alias("t0"), c("gain").alias("g0"), c("next_time").alias("t1"),
        c("next_gain").alias("g1"), c("next_easing").alias("easing"),
    )
    ahead = F.struct(
        F.lit(None).cast("double").alias("t0"), c("gain").alias("g0"),
        c("time").alias("t1"), c("gain").alias("g1"), c("easing").alias("easing"),
    )
    minus = F.lit(float("-inf"))
    starts = F.array(F.struct(c("time").alias("t"), here.alias("s")))
    first = F.array(F.struct(minus.alias("t"), ahead.alias("s")))
    pieces = seg.select(
        *keys,
        F.explode(
            F.when(c("prev_time").isNull(), F.concat(first, starts)).otherwise(starts)
        ).alias("x"),
    ).select(*keys, c("x.t").alias("_t"), F.lit(0).alias("_kind"), c("x.s").alias("_seg"))
    rows = probes.select(
        *keys, c(at).cast("double").alias("_t"), F.lit(1).alias("_kind"),
        F.struct(*[c(x) for x in probes.columns]).alias("_row"),
    )
    both = rows.unionByName(pieces, allowMissingColumns=True)
    bound = frames.top + 1 + biggest(probes, keys)
    found = ordered(both, keys, ["_t", "_kind"], bound=bound).scan(fill={"_s": c("_seg")}).df
    s, t = c("_s"), c("_t")
    inner = envelope_value(t, s["t0"], s["g0"], s["t1"], s["g1"], s["easing"])
    value = F.when(s["t0"].isNull() | s["t1"].isNull(), s["g0"]).otherwise(inner)
    inside = s["t0"].isNotNull() & (s["t1"].isNotNull() | (t == s["t0"]))
    return found.where(c("_kind") == 1).select(
        c("_row.*"), value.alias("envelope"), F.coalesce(inside, F.lit(False)).alias("inside")
    )


# Edits. Rows pushed by an edit win over rows at the same time.


def replace_groups(current: DataFrame, replaced: DataFrame, rows: DataFrame, keys) -> DataFrame:
    """Set the lists of the keys in ``replaced`` to ``rows``; a key without rows is cleared."""
    keys = _list(keys)
    kept = current.join(replaced.select(*keys).distinct(), keys, "left_anti")
    new = rows.join(replaced.select(*keys).distinct(), keys, "left_semi")
    return kept.select(*keys, *FIELDS).unionByName(
        normalize_keyframes(new.select(*keys, *FIELDS), keys)
    )


def clear_groups(current: DataFrame, cleared: DataFrame | None, keys) -> DataFrame:
    """Drop the lists of some keys, or of all when ``cleared`` is None."""
    if cleared is None:
        return current.limit(0)
    return current.join(cleared, _list(keys), "left_anti")


def patch_rows(current: DataFrame | Ordered, patches: DataFrame, keys) -> DataFrame:
    """Update the named fields of ``idx``; a null patch field keeps the value.

    ``patches`` holds at most one row per (key, idx).
    """
    keys = _list(keys)
    p = patches.select(
        *keys, "idx", *[c(x).alias(f"_p_{x}") for x in ("time", "gain", "easing")],
        F.lit(1).alias("_hit"),
    )
    current, top = _table(current)
    joined = current.join(p, [*keys, "idx"], "left")
    edited = joined.select(
        *keys,
        *[F.coalesce(c(f"_p_{x}"), c(x)).alias(x) for x in ("time", "gain", "easing")],
        "ord", F.coalesce(c("_hit"), F.lit(0)).alias("_pushed"),
    )
    return _settle(edited, keys, top)


def insert_rows(current: DataFrame | Ordered, new: DataFrame, keys) -> DataFrame:
    """Add rows; ``idx`` tells where each ended up in the normal form."""
    keys = _list(keys)
    current, top = _table(current)
    both = current.select(*keys, *FIELDS, F.lit(0).alias("_pushed")).unionByName(
        new.select(*keys, *FIELDS, F.lit(1).alias("_pushed"))
    )
    return _settle(both, keys, None if top is None else top + biggest(new, keys))


def inserted_index(settled: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Index of each inserted row, -1 when it was dropped as invalid."""
    keys = _list(keys)
    valid = is_finite(c("time")) & is_finite(c("gain"))
    wanted = new.select(*keys, "ord", F.when(valid, F.greatest(F.lit(0.0), c("time"))).alias("_at"))
    hit = band_match(wanted, settled, keys, [], SAME_TIME, [*keys, "ord"])
    return (
        wanted.select(*keys, "ord").join(hit, [*keys, "ord"], "left")
        .select(*keys, "ord", F.coalesce("idx", F.lit(-1)).alias("idx"))
    )


def delete_rows(current: DataFrame | Ordered, refs: DataFrame, keys) -> DataFrame:
    """Remove (key, idx) refs and close the gaps."""
    keys = _list(keys)
    current, top = _table(current)
    rest = current.join(refs.select(*keys, "idx"), [*keys, "idx"], "left_anti").drop("idx")
    return indexed(ordered(rest, keys, ["time", "ord"], bound=top)).df


def shift_rows(current: DataFrame | Ordered, moved: DataFrame, keys) -> DataFrame:
    """Move the rows named in ``moved`` (keys, idx, delta); times stay at or above 0."""
    keys = _list(keys)
    m = moved.select(*keys, "idx", "delta")
    current, top = _table(current)
    joined = current.join(m, [*keys, "idx"], "left")
    target = F.greatest(F.lit(0.0), c("time") + c("delta"))
    placed = joined.withColumn("time", F.when(c("delta").isNotNull(), target).otherwise(c("time")))
    return _settle(placed.select(*keys, *FIELDS, F.lit(0).alias("_pushed")), keys, top)


def reresolve_by_value(settled: DataFrame, wanted: DataFrame, keys) -> DataFrame:
    """Index of moved keyframes by gain, easing and a time within ``MOVED_TIME``.

    ``wanted``: keys, ``ref``, ``time``, ``gain``, ``easing``. First match; no match, no row.
    """
    keys = _list(keys)
    w = wanted.select(*keys, "ref", c("time").alias("_at"), "gain", "easing")
    return band_match(w, settled, keys, ["gain", "easing"], MOVED_TIME, [*keys, "ref"])


def band_match(left, right, keys, same, width: float, ident) -> DataFrame:
    """First ``idx`` on the right whose time lies within ``width`` of ``_at``.

    Both sides are put on a grid of ``width``; a left row looks into three cells.
    """
    cell = F.floor(c("_at") / width)
    l = left.where(c("_at").isNotNull()).select(
        "*", F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell")
    )
    r = right.select(
        *keys, *same, "idx", c("time").alias("_time"), F.floor(c("time") / width).alias("_cell")
    )
    hit = l.join(r, [*keys, *same, "_cell"]).where(F.abs(c("_time") - c("_at")) < width)
    return hit.groupBy(*ident).agg(F.min("idx").alias("idx"))


def clamped_shift(selected: DataFrame, keys, delta: Column, duration: Column) -> DataFrame:
    """Largest shift of a group that keeps every row inside the song."""
    bounds = selected.groupBy(*_list(keys)).agg(
        F.min("time").alias("_low"), F.max("time").alias("_high"),
        F.first(delta).alias("_delta"), F.first(duration).alias("_duration"),
    )
    d = (
        F.when(c("_duration") <= 0, 0.0)
        .when(c("_delta") < -c("_low"), -c("_low"))
        .when(c("_delta") > c("_duration") - c("_high"), c("_duration") - c("_high"))
        .otherwise(c("_delta"))
    )
    return bounds.select(*_list(keys), d.alias("delta"))


def add_fades(current: DataFrame | Ordered, requests: DataFrame, keys) -> DataFrame:
    """Fade in, fade out or duplicate one keyframe per key.

    ``requests``: keys, ``source`` (idx), ``kind`` (``in``, ``out``, ``duplicate``),
    ``playhead``, ``duration``.
    """
    keys = _list(keys)
    current, top = _table(current)
    joined = current.join(
        requests.select(*keys, "source", "kind", "playhead", "duration"), keys, "left"
    )
    source = F.coalesce(c("idx") == c("source"), F.lit(False))
    fade_in = F.coalesce(c("kind") == "in", F.lit(False))
    zero = fade_in & (c("idx") == 0) & (c("time") < AT_ZERO)
    gain = F.when(zero, 0.0).when(fade_in & source, 1.0).otherwise(c("gain"))
    easing = F.when(zero, "linear").otherwise(c("easing"))
    later = F.when(
        c("playhead") > c("time") + 1e-6, c("playhead")
    ).otherwise(c("time") + DUPLICATE_SECONDS)
    end = F.least(
        c("time") + FADE_OUT_SECONDS, F.greatest(c("time"), c("duration"))
    )
    copy = F.least(F.greatest(F.lit(0.0), later), F.greatest(F.lit(0.0), c("duration")))

    def row(t, g, e, pushed):
        return F.struct(
            t.alias("time"), g.alias("gain"), e.alias("easing"), F.lit(pushed).alias("_pushed")
        )

    same = row(c("time"), gain, easing, 0)
    linear, silent = F.lit("linear"), F.lit(0.0)
    added = (
        F.when(
            fade_in & (c("idx") == 0) & (c("time") >= AT_ZERO),
            F.array(same, row(silent, silent, linear, 1)),
        )
        .when(source & (c("kind") == "out"), F.array(same, row(end, silent, linear, 1)))
        .when(
            source & (c("kind") == "duplicate"),
            F.array(same, row(copy, c("gain"), c("easing"), 1)),
        )
        .otherwise(F.array(same))
    )
    rows = joined.select(*keys, "ord", F.explode(added).alias("r")).select(
        *keys, "r.time", "r.gain", "r.easing", "ord", "r._pushed"
    )
    return _settle(rows, keys, None if top is None else top + 1)


def encode_keyframes(keyframes: DataFrame, keys) -> DataFrame:
    """The flat integer list ``time*100, gain*100, flag, ...`` of each key.

    The saved format holds a series in one list; ``items`` is the number of keyframes, and
    :func:`lists_per_key` says when ``reason`` is set.
    """
    triple = F.array(
        round_half_up(c("time") * 100), round_half_up(c("gain") * 100),
        F.when(c("easing") == "hold", 1).otherwise(0).cast("bigint"),
    )
    lists = lists_per_key(keyframes, keys, ["time", "ord"], triple, "triples")
    return lists.withColumn("flat", F.flatten("triples")).drop("triples")


def stale_keys(current: DataFrame, restored: DataFrame, keys) -> DataFrame:
    """Keys held now that a restored snapshot does not have."""
    keys = _list(keys)
    return current.select(*keys).subtract(restored.select(*keys))


def replay_snapshot(tracks: DataFrame, stored: DataFrame, track_keys, fields) -> DataFrame:
    """Stored fields win for tracks that still exist."""
    keys = _list(track_keys)
    s = stored.select(
        *keys, F.struct(*fields).alias("_stored"),
    )
    joined = tracks.join(s, keys, "left")
    kept = [x for x in tracks.columns if x not in fields]
    return joined.select(
        *kept,
        *[
            F.when(c("_stored").isNotNull(), c("_stored")[x]).otherwise(c(x)).alias(x)
            for x in fields
        ],
    )


def _table(current: DataFrame | Ordered) -> tuple[DataFrame, int | None]:
    if isinstance(current, Ordered):
        return current.df, current.top
    return current, None


def _settle(df: DataFrame, keys, bound: int | None = None) -> DataFrame:
    done = indexed(normal_order(df, keys, ("time", "_pushed", "ord"), bound))
    return done.df.drop("_pushed")


def _list(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)
