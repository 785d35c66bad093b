"""Track, mix and level queries on embeddings and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelane.functions.scalars import effective_gain, fixed
from timelane.operators import keyframes as K
from timelane.operators import levels as L
from timelane.operators import mix as M
from timelane.plans.inputs import (
    BLOCK,
    MEMBERS_SQL,
    PLACED_SQL,
    RATE,
    SAMPLES_SQL,
    TRACK_KF_SQL,
    TRACKS_SQL,
    blocks,
    members,
    track_keyframes,
    tracks,
)
from timelane.plans.registry import query
from timelane.sources.pairs import named_pairs

c = F.col


def placed(t):
    return M.positions(members(t), "mix", "track")


SOLO_SQL = f"""{MEMBERS_SQL},
    flagged as (select *, bool_or(solo) over (partition by mix) as any_solo from members)"""


@query("any_solo", f"with {SOLO_SQL} select mix, track, any_solo from flagged")
def _(t):
    return M.any_solo(members(t)).select("mix", "track", "any_solo")


@query(
    "effective_gain",
    f"""with {SOLO_SQL} select mix, track,
        case when case when any_solo then solo else not muted end then gain else 0.0 end as gain
    from flagged""",
)
def _(t):
    g = effective_gain(c("gain"), c("muted"), c("solo"), c("any_solo"))
    return M.any_solo(members(t)).select("mix", "track", g.alias("gain"))


@query(
    "audible_only",
    f"""with {SOLO_SQL} select mix, track from flagged
    where case when any_solo then solo else not muted end and gain <> 0""",
)
def _(t):
    return M.gated(members(t)).where("gate > 0 and gain <> 0").select("mix", "track")


@query("parity_side", f"with {PLACED_SQL} select mix, track, idx, pair, side from placed")
def _(t):
    return placed(t).select("mix", "track", "idx", "pair", "side")


@query(
    "pair_tracks",
    """with n as (select label as mix, vec_id, row_number() over (partition by label order by vec_id)
        - 1 as idx from embeddings)
    select mix, idx // 2 + 1 as pair, max(case when idx % 2 = 0 then vec_id end) as left_track,
        max(case when idx % 2 = 1 then vec_id end) as right_track
    from n group by mix, idx // 2""",
)
def _(t):
    rows = t.embeddings.select(c("label").alias("mix"), "vec_id")
    return M.pair_tracks(M.positions(rows, "mix", "vec_id"), "mix", "vec_id")


@query(
    "stereo_join",
    f"""with {SAMPLES_SQL},
    l as (select track // 2 as pair, frame, value from samples where track % 2 = 0),
    r as (select track // 2 as pair, frame, value from samples where track % 2 = 1)
    select coalesce(l.pair, r.pair) as pair, coalesce(l.frame, r.frame) as frame,
        coalesce(l.value, 0.0) as left_value, coalesce(r.value, 0.0) as right_value
    from l full join r on l.pair = r.pair and l.frame = r.frame""",
)
def _(t):
    rows = L.sample_rows(blocks(t), "track").withColumn("pair", F.floor(c("track") / 2))
    return M.stereo_join(rows.where("track % 2 = 0"), rows.where("track % 2 = 1"))


@query(
    "apply_targets",
    f"""with {PLACED_SQL}, targets as (
        select mix, pair, track, pair as ord from placed
        union all select mix, pair + 1, track, pair + 1 from placed where side = 'R')
    select mix, track, max(pair) as pair from targets
    where pair % 3 <> 0 and exists (select 1 from placed p where p.mix = targets.mix
        and p.pair = targets.pair) group by mix, track""",
)
def _(t):
    p = placed(t)
    own = p.select("mix", "pair", "track", c("pair").alias("ord"))
    extra = p.where("side = 'R'").select(
        "mix", (c("pair") + 1).alias("pair"), "track", (c("pair") + 1).alias("ord")
    )
    return M.apply_targets(own.unionByName(extra), p.where("pair % 3 <> 0"))


@query(
    "preview_mask",
    f"with {PLACED_SQL} select mix, track, pair <> 2 as muted from placed",
)
def _(t):
    p = placed(t)
    return M.preview_mask(p, p.where("pair = 2")).select("mix", "track", "muted")


@query(
    "restore_baseline",
    f"""with {MEMBERS_SQL} select mix, track, case when track % 3 = 0 then true else muted end as muted
    from members""",
)
def _(t):
    rows = members(t)
    silent, baseline = M.mute_all(rows)
    silent, baseline = M.mute_all(silent, baseline)
    return M.restore_baseline(silent, baseline.where("track % 3 <> 0")).select(
        "mix", "track", "muted"
    )


@query(
    "mute_all",
    f"with {MEMBERS_SQL} select mix, track, true as muted from members",
)
def _(t):
    return M.mute_all(members(t))[0].select("mix", "track", "muted")


@query(
    "set_many",
    f"""with {PLACED_SQL} select mix, track,
        case when pair % 2 = 0 then 0.5 else gain end as gain,
        case when pair % 3 = 0 then case side when 'L' then -1.0 else 1.0 end else pan end as pan,
        case when pair % 4 = 0 then false when pair % 4 = 1 then true else muted end as muted
    from placed""",
)
def _(t):
    p = placed(t)
    pair = c("pair")
    changes = p.select("mix", "pair").distinct().select(
        "mix", "pair", F.when(pair % 2 == 0, 0.5).alias("gain"),
        F.when(pair % 3 == 0, 7.0).alias("spread"),
        F.when(pair % 4 == 0, True).when(pair % 4 == 1, False).alias("enabled"),
    )
    return M.set_pairs(p, changes).select("mix", "track", "gain", "pan", "muted")


@query(
    "any_all_on",
    f"""with {PLACED_SQL}, refs as (select mix, pair,
        coalesce(max(case when side = 'L' and track % 4 <> 0 then muted end),
            max(case when side = 'R' and track % 4 <> 0 then muted end)) as muted
        from placed group by mix, pair)
    select mix, coalesce(bool_or(not muted), false) as any_on,
        count(muted) > 0 and coalesce(bool_and(not muted), false) as all_on
    from refs group by mix""",
)
def _(t):
    def on(side):
        return F.max(F.when((c("side") == side) & (c("track") % 4 != 0), c("muted")))

    refs = placed(t).groupBy("mix", "pair").agg(F.coalesce(on("L"), on("R")).alias("muted"))
    return M.any_all_on(refs)


@query(
    "mix_duration",
    """select label as mix, greatest(0.0::double, coalesce(max(len(embedding) / (1 + vec_id % 7)), 0))
        as duration from embeddings group by label""",
)
def _(t):
    d = F.size("embedding") / (1 + c("vec_id") % 7)
    return M.mix_duration(t.embeddings.select(c("label").alias("mix"), d.alias("duration")))


@query(
    "order_tracks",
    f"with {PLACED_SQL} select mix, track, idx from placed where not muted",
)
def _(t):
    p = placed(t)
    return M.order_tracks(p.select("mix", "track", "idx"), p.where("not muted"))


@query(
    "mixdown",
    f"""with {TRACKS_SQL}, {SAMPLES_SQL}, {TRACK_KF_SQL},
    gate as (select *, case when bool_or(solo) over (partition by mix) then solo else not muted end
        as on_air from tracks),
    ext as (select track, min(time) as ft, max(time) as lt from tk group by track),
    seg as (select track, time as t0, gain as g0, lead(time) over w as t1, lead(gain) over w as g1,
        lead(easing) over w as e1 from tk window w as (partition by track order by time)),
    timed as (select s.*, s.frame / 16.0::double as at from samples s),
    gained as (select s.mix, s.frame, s.value, g.pan, g.on_air,
        case when e.track is null or s.at < e.ft or s.at > e.lt then g.gain
            when q.t1 is null or q.e1 = 'hold' then q.g0
            else q.g0 + (q.g1 - q.g0) * ((s.at - q.t0) / (q.t1 - q.t0)) end as gain
        from timed s join gate g on s.mix = g.mix and s.track = g.track
            left join ext e on e.track = s.track
            asof left join seg q on q.track = s.track and s.at >= q.t0)
    select mix, frame,
        floor(sum(case when on_air then value * gain * cos((pan + 1.0) / 2.0 * (pi() / 2.0))
            else 0 end) * 0.8 * 1e6 + 0.5) / 1e6 as left_value,
        floor(sum(case when on_air then value * gain * sin((pan + 1.0) / 2.0 * (pi() / 2.0))
            else 0 end) * 0.8 * 1e6 + 0.5) / 1e6 as right_value
    from gained group by mix, frame""",
)
def mixdown(t):
    kfs = K.normal_order(track_keyframes(t), ["mix", "track"])
    frames = t.embeddings.select(
        c("label").alias("mix"), c("vec_id").alias("track"),
        F.size("embedding").cast("bigint").alias("frames"),
    )
    out = M.mixdown(
        blocks(t), tracks(t), kfs, rate=RATE, block_size=BLOCK, master=0.8, frames=frames
    )
    return out.select(
        "mix", "frame", fixed(c("left_value")).alias("left_value"),
        fixed(c("right_value")).alias("right_value"),
    )


@query(
    "mixdown_sliders",
    f"""with {TRACKS_SQL}, {SAMPLES_SQL},
    gate as (select *, case when bool_or(solo) over (partition by mix) then solo else not muted end
        as on_air from tracks)
    select s.mix, s.frame,
        floor(sum(case when on_air then value * gain * cos((pan + 1.0) / 2.0 * (pi() / 2.0))
            else 0 end) * 1e6 + 0.5) / 1e6 as left_value,
        floor(sum(case when on_air then value * gain * sin((pan + 1.0) / 2.0 * (pi() / 2.0))
            else 0 end) * 1e6 + 0.5) / 1e6 as right_value
    from samples s join gate g on s.mix = g.mix and s.track = g.track group by s.mix, s.frame""",
)
def _(t):
    """No keyframes; lengths are read from the blocks."""
    out = M.mixdown(blocks(t), tracks(t), rate=RATE, block_size=BLOCK)
    return out.select(
        "mix", "frame", fixed(c("left_value")).alias("left_value"),
        fixed(c("right_value")).alias("right_value"),
    )


@query(
    "waveform_peaks",
    f"""with {SAMPLES_SQL} select track, frame // 6 as bin, max(abs(value)) as peak
    from samples where frame // 6 < 10 group by track, frame // 6""",
)
def _(t):
    frames = t.embeddings.select(
        c("vec_id").alias("track"), F.size("embedding").cast("bigint").alias("frames")
    )
    return L.waveform_peaks(blocks(t), 10, frames=frames)


@query(
    "waveform_peaks_wide",
    f"""with {SAMPLES_SQL},
    share as (select vec_id as track, greatest(1, 100 * (1 + vec_id % 3) // 3) as bins from embeddings),
    sized as (select *, greatest(1, 64 // bins) as spb from share)
    select s.track, frame // spb as bin, max(abs(value)) as peak
    from samples s join sized z on s.track = z.track where frame // spb < bins
    group by s.track, frame // spb
    union all select track, unnest(range(64, bins)) as bin, 0.0 from sized where bins > 64""",
)
def _(t):
    rows = blocks(t).withColumn("seconds", (1 + c("track") % 3).cast("double"))
    return L.waveform_peaks(rows, 100, F.lit(3.0), c("seconds"))


LEVEL_SQL = f"""{SAMPLES_SQL}, lv as (select mix, track, frame // 24 as "window",
        max(abs(value)) as peak, sqrt(sum(value * value) / 24) as rms
        from samples group by mix, track, frame // 24)"""


@query(
    "level_window",
    f"""with {LEVEL_SQL} select mix, track, "window", peak,
        floor(rms * 1e6 + 0.5) / 1e6 as rms from lv""",
)
def _(t):
    levels = L.level_window(blocks(t), 24)
    return levels.withColumn("rms", fixed(c("rms")))


NUMBERED_SQL = f"""{LEVEL_SQL}, n as (select label as mix, vec_id as track,
        row_number() over (partition by label order by vec_id) - 1 as idx from embeddings),
    li as (select lv.*, n.idx from lv join n on lv.mix = n.mix and lv.track = n.track)"""


def numbered_levels(t):
    place = M.positions(tracks(t).select("mix", "track"), "mix", "track")
    return L.level_window(blocks(t), 24).join(place, ["mix", "track"])


@query(
    "pair_level",
    f"""with {NUMBERED_SQL} select mix, "window", idx // 2 + 1 as pair,
        greatest(0.0, max(peak)) as peak from li group by mix, "window", idx // 2""",
)
def _(t):
    return L.pair_level(numbered_levels(t), ["mix", "window"])


@query(
    "master_level",
    f"""with {NUMBERED_SQL} select mix, "window",
        greatest(0.0, max(case when idx % 2 = 0 then peak end)) as left_peak,
        greatest(0.0, max(case when idx % 2 = 1 then peak end)) as right_peak
    from li group by mix, "window\"""",
)
def _(t):
    return L.master_level(numbered_levels(t), ["mix", "window"])


@query(
    "level_zone",
    f"""with {NUMBERED_SQL}, p as (select mix, "window", idx // 2 + 1 as pair,
        greatest(0.0, max(peak)) * 3 as peak from li group by mix, "window", idx // 2)
    select mix, "window", pair, floor(least(1.0::double, peak / 1.2) * 1e6 + 0.5) / 1e6 as bar,
        case when peak >= 0.95 then 'danger' when peak >= 0.75 then 'warn' else 'ok' end as zone,
        case when peak >= 0.95 then 'danger' else 'ok' end as pair_zone
    from p""",
)
def _(t):
    peaks = L.pair_level(numbered_levels(t), ["mix", "window"]).withColumn("peak", c("peak") * 3)
    zoned = L.with_zones(peaks)
    return zoned.select(
        "mix", "window", "pair", fixed(c("bar")).alias("bar"), "zone", "pair_zone"
    )


@query(
    "compact_state_build",
    f"""with {PLACED_SQL}, lefts as (select mix, pair,
        max(case when side = 'L' and track % 6 <> 0 then struct_pack(gain, pan, muted) end) as x
        from placed group by mix, pair),
    vals as (select mix, pair, case when coalesce(not x.muted, true) then 1 else 0 end::bigint as m,
        cast(floor(coalesce(x.gain, 1.0) * 100 + 0.5) as bigint) as g,
        cast(floor(coalesce(abs(x.pan), 1.0) * 100 + 0.5) as bigint) as p from lefts)
    select mix, pair, m, g, p from vals""",
)
def _(t):
    p = placed(t).withColumn("track", F.when(c("track") % 6 != 0, c("track")))
    return M.compact_state(p, "mix")


@query(
    "snapshot",
    """select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey,
        l_suppkey, l_quantity, l_extendedprice) - 1 as position, l_linenumber, l_quantity from lineitem""",
)
def _(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return M.snapshot(t.lineitem, "l_orderkey", order, ["l_linenumber", "l_quantity"])


@query(
    "replay_snapshot",
    f"""with {MEMBERS_SQL} select mix, track,
        case when track % 3 = 0 then 1.0 - gain else gain end as gain,
        case when track % 3 = 0 then -pan else pan end as pan,
        case when track % 3 = 0 then not muted else muted end as muted, solo from members""",
)
def _(t):
    rows = members(t)
    stored = rows.where("track % 3 = 0").select(
        "mix", "track", (1.0 - c("gain")).alias("gain"), (-c("pan")).alias("pan"),
        (~c("muted")).alias("muted"),
    )
    out = K.replay_snapshot(rows, stored, ["mix", "track"], ["gain", "pan", "muted"])
    return out.select("mix", "track", "gain", "pan", "muted", "solo")


@query(
    "write_pairs",
    f"""with {SAMPLES_SQL},
    st as (select track // 2 as pair, frame, max(case when track % 2 = 0 then value end) as l,
        max(case when track % 2 = 1 then value end) as r from samples group by 1, 2),
    q as (select pair, frame, greatest(-1.0, least(1.0, coalesce(l, 0.0))) as l,
        greatest(-1.0, least(1.0, coalesce(r, 0.0))) as r from st)
    select 'pair_' || case when pair < 10 then '0' else '' end || pair || case when pair % 3 = 0
            then '_pair' when pair % 3 = 1 then '_' || pair || '_left+right' else '_-' end as name, frame,
        trunc(case when l < 0 then l * 32768 else l * 32767 end)::smallint as left_pcm,
        trunc(case when r < 0 then r * 32768 else r * 32767 end)::smallint as right_pcm from q""",
)
def _(t):
    rows = L.sample_rows(blocks(t), "track").withColumn("pair", F.floor(c("track") / 2))
    stereo = M.stereo_join(rows.where("track % 2 = 0"), rows.where("track % 2 = 1"))
    pair = c("pair")
    labels = rows.select("pair").distinct().where("pair % 3 <> 2").select(
        "pair", F.when(pair % 3 == 0, F.lit("!!")).otherwise(
            F.concat(pair.cast("string"), F.lit(" LEFT+RIGHT"))).alias("label")
    )
    return named_pairs(stereo, labels)
