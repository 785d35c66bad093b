"""Whole mixes saved, changed and brought back: nations as mixes, users' events as automation."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelane.operators import keyframes as K
from timelane.operators import mix as M
from timelane.operators import snapshots as Z
from timelane.plans.inputs import NORMAL_SQL, PLACED_SQL, members, raw_keyframes
from timelane.plans.registry import query
from timelane.sources import state as S

c = F.col


def whole(t):
    """Mixes, placed tracks and keyframes of their pairs."""
    mixes = t.nation.select(
        c("n_nationkey").alias("mix"), (0.5 + c("n_nationkey") / 20).alias("master"),
        F.lit(None).cast("double").alias("loop_start"), F.lit(None).cast("double").alias("loop_end"))
    tracks = M.positions(members(t), "mix", "track")
    series = c("series")
    frames = K.normal_order(raw_keyframes(t), "series").df.select(
        (series % 25).cast("bigint").alias("mix"), (F.floor(series / 25) + 1).alias("pair"),
        "time", "gain", "easing", "ord")
    return mixes, tracks, frames


WHOLE_SQL = f"""{PLACED_SQL}, {NORMAL_SQL},
    mixes as (select n_nationkey as mix, 0.5::double + n_nationkey / 20 as master from nation),
    frames as (select series % 25 as mix, series // 25 + 1 as pair, time, gain, easing, ord from nk)"""


def changed(mixes, tracks, frames):
    """Everything another way: other gains, no solo, keyframes moved to the next pair."""
    return (
        mixes.withColumn("master", F.lit(0.1)),
        tracks.withColumn("gain", F.lit(0.3)).withColumn("pan", F.lit(0.0)).withColumn("muted", ~c("muted"))
        .withColumn("solo", F.lit(False)),
        frames.withColumn("pair", c("pair") + 1).withColumn("gain", F.lit(0.2)),
    )


def _applied(t):
    mixes, tracks, frames = whole(t)
    texts = Z.saved_states(mixes, tracks, frames)
    payload = F.concat(F.lit("#s="), S.write_compact_state(c("text")))
    saved = texts.select("mix", S.read_compact_state(payload).alias("state"))
    return Z.apply_saved(saved, *changed(mixes, tracks, frames))


@query(
    "apply_saved_tracks",
    f"""with {WHOLE_SQL}, lefts as (select mix, pair, max(case when side = 'L' then
            struct_pack(gain, pan, muted) end) as x from placed group by mix, pair)
    select mix, track, side, floor(x.gain * 100 + 0.5) / 100 as gain,
        case side when 'L' then -1 else 1 end * floor(abs(x.pan) * 100 + 0.5) / 100 as pan,
        x.muted as muted, false as solo from placed join lefts using (mix, pair)""",
)
def _(t):
    return _applied(t)[1].select("mix", "track", "side", "gain", (c("pan") + 0.0).alias("pan"), "muted", "solo")


@query(
    "apply_saved_keyframes",
    f"""with {WHOLE_SQL} select mix, pair, floor(time * 100 + 0.5) / 100 as time,
        floor(gain * 100 + 0.5) / 100 as gain, easing from frames f
    where exists (select 1 from placed p where p.mix = f.mix and p.pair = f.pair)
    union all select mix, pair + 1, time, 0.2, easing from frames
    where mix not in (select mix from placed)""",
)
def _(t):
    return _applied(t)[2].drop("ord")


@query(
    "apply_saved_masters",
    f"""with {WHOLE_SQL} select mix, case when mix in (select mix from placed)
        then least(1.5, floor(master * 100 + 0.5) / 100) else 0.1 end as master from mixes""",
)
def _(t):
    return _applied(t)[0].select("mix", "master")


def _replayed(t):
    now = whole(t)
    return Z.replay_whole(Z.whole_snapshot(*now), *changed(*now))


@query("replay_whole_tracks", f"with {WHOLE_SQL} select mix, track, gain, pan, muted, solo from placed")
def _(t):
    return _replayed(t)[1].select("mix", "track", "gain", "pan", "muted", "solo")


@query("replay_whole_keyframes", f"with {WHOLE_SQL} select mix, pair, time, gain, easing from frames")
def _(t):
    return _replayed(t)[2].drop("ord")


@query("replay_whole_masters", f"with {WHOLE_SQL} select mix, master from mixes")
def _(t):
    return _replayed(t)[0].select("mix", "master")


@query(
    "whole_snapshot",
    f"""with {WHOLE_SQL} select mix, 'mix' as kind, null::bigint as part, null::bigint as position,
        master as value from mixes
    union all select mix, 'track', track, null, gain from placed
    union all select mix, 'keyframe', pair, row_number() over (partition by mix, pair order by time, ord) - 1,
        gain from frames""",
)
def _(t):
    rows = Z.whole_snapshot(*whole(t))
    part = F.coalesce("track", "pair").cast("bigint")
    value = F.coalesce("master", "gain", "frame_gain")
    return rows.select("mix", "kind", part.alias("part"), c("position").cast("bigint").alias("position"),
                       value.alias("value"))
