"""Keyframe queries on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelane.functions.scalars import fixed, piecewise_gain
from timelane.operators import keyframes as K
from timelane.operators.ordered import ordered
from timelane.plans.inputs import (
    HOUR,
    NORMAL_SQL,
    RAW_SQL,
    START,
    micros,
    raw_keyframes,
    settle_sql,
)
from timelane.plans.registry import query

c = F.col
COLS = ["series", "time", "gain", "easing", "ord", "idx"]


def in_order(t):
    return K.normal_order(raw_keyframes(t), "series")


def normal(t):
    return in_order(t).df


def placed(t):
    return K.indexed(in_order(t))


def numbered(t):
    return placed(t).df


def series(t):
    return t.events.select(c("user_id").alias("series")).distinct()


SERIES_SQL = "series as (select distinct user_id as series from events)"


@query(
    "drop_non_finite",
    f"""with {RAW_SQL} select series, ord, time, gain from raw
    where not isnan(time) and not isinf(time) and not isnan(gain) and not isinf(gain)""",
)
def _(t):
    return K.drop_non_finite(raw_keyframes(t)).select("series", "ord", "time", "gain")


@query("normalize_keyframes", f"with {NORMAL_SQL} select series, time, gain, easing, ord from nk")
def _(t):
    return normal(t).select("series", "time", "gain", "easing", "ord")


@query(
    "dedupe_last",
    f"""with s as (select user_id as series, event_id as ord,
            round((epoch_us(ts) - {START}) / {HOUR}.0::double) as time from events)
    select series, ord, time from (select *, lead(time) over (partition by series order by time, ord)
        as nxt from s) where nxt is null or nxt - time >= 1e-9""",
)
def _(t):
    rows = t.events.select(
        c("user_id").alias("series"), c("event_id").alias("ord"),
        F.round(micros() / float(HOUR)).alias("time"),
    )
    return K.dedupe_last(ordered(rows, "series", ["time", "ord"])).df


@query("renumber", f"with {NORMAL_SQL} select series, ord, idx from nk")
def _(t):
    return numbered(t).select("series", "ord", "idx")


@query(
    "segments",
    f"""with {NORMAL_SQL} select series, ord, time, gain,
        lag(time) over w as prev_time, lag(gain) over w as prev_gain,
        lead(time) over w as next_time, lead(gain) over w as next_gain,
        lead(easing) over w as next_easing
    from nk window w as (partition by series order by time, ord)""",
)
def _(t):
    return K.segments(in_order(t), "series").select(
        "series", "ord", "time", "gain", "prev_time", "prev_gain", "next_time", "next_gain",
        "next_easing",
    )


@query(
    "fill_hold",
    f"""with {NORMAL_SQL} select series, ord,
        last_value(case when easing = 'hold' then gain end ignore nulls) over
            (partition by series order by time, ord rows unbounded preceding) as held from nk""",
)
def _(t):
    return K.fill_hold(in_order(t), "series").select("series", "ord", "held")


@query(
    "time_extent",
    f"""with {NORMAL_SQL} select series, min(time) as first_time, max(time) as last_time,
        count(*) > 0 as has_automation from nk group by series""",
)
def _(t):
    return K.time_extent(normal(t), "series")


PROBES_SQL = f"""probes as (select event_id, user_id as series, event_type,
        (epoch_us(ts) - {START}) / {HOUR}.0::double - 24 as at
        from events),
    firsts as (select series, min(time) as ft, arg_min(gain, time) as fg, max(time) as lt
        from nk group by series),
    seg as (select series, time as t0, gain as g0, lead(time) over w as t1, lead(gain) over w as g1,
        lead(easing) over w as e1 from nk window w as (partition by series order by time)),
    env as (select p.event_id, p.series, p.at,
        case when f.series is null then null
            when s.series is null then f.fg
            when s.t1 is null or s.e1 = 'hold' then s.g0
            else s.g0 + (s.g1 - s.g0) * ((p.at - s.t0) / (s.t1 - s.t0)) end as envelope,
        coalesce(p.at >= f.ft and p.at <= f.lt, false) as inside
    from probes p left join firsts f on p.series = f.series
        asof left join seg s on p.series = s.series and p.at >= s.t0)"""


def probes(t):
    return t.events.select(
        "event_id", c("user_id").alias("series"), (micros() / float(HOUR) - 24).alias("at")
    )


@query(
    "envelope_at",
    f"""with {NORMAL_SQL}, {PROBES_SQL} select event_id, series,
        floor(envelope * 1e6 + 0.5) / 1e6 as envelope, inside from env""",
)
def _(t):
    found = K.envelope_at(probes(t), in_order(t), "series")
    return found.select("event_id", "series", fixed(c("envelope")).alias("envelope"), "inside")


@query(
    "piecewise_gain",
    f"""with {NORMAL_SQL}, {PROBES_SQL} select event_id, series,
        floor((case when inside then envelope else (series % 16) / 10.0::double end
            * case when event_id % 5 = 0 then 0.0 else 1.0 end) * 1e6 + 0.5) / 1e6 as gain
    from env""",
)
def _(t):
    rows = probes(t)
    found = K.envelope_at(rows, in_order(t), "series")
    slider = c("series") % 16 / 10.0
    gate = F.when(c("event_id") % 5 == 0, 0.0).otherwise(1.0)
    at = c("at")
    low = F.when(c("inside"), at).otherwise(at + 1)
    gain = piecewise_gain(at, low, at, c("envelope"), slider, gate)
    return found.select("event_id", "series", fixed(gain).alias("gain"))


@query(
    "replace_group",
    f"""with {NORMAL_SQL},
    repl as (select series, time + 0.5 as time, gain * 2 as gain, easing, ord, 0 as pushed
        from raw where series % 3 = 0 and series % 2 = 0),
    {settle_sql('repl', 'rn')}
    select series, time, gain, easing, ord from nk where series % 3 <> 0
    union all select series, time, gain, easing, ord from rn""",
)
def _(t):
    raw = raw_keyframes(t)
    rows = raw.where("series % 2 = 0").withColumn("time", c("time") + 0.5).withColumn(
        "gain", c("gain") * 2
    )
    keys = series(t).where("series % 3 = 0")
    return K.replace_groups(normal(t), keys, rows, "series")


PATCH_SQL = f"""{NORMAL_SQL}, patched as (select series,
        case when idx = series % 5 and series % 2 = 0 then 100.0 else time end as time,
        case when idx = series % 5 then 0.7 else gain end as gain, easing, ord,
        case when idx = series % 5 then 1 else 0 end as pushed from nk),
    {settle_sql('patched', 'pn')}"""


@query("patch_row", f"with {PATCH_SQL} select series, time, gain, easing, ord, idx from pn")
def _(t):
    s = c("series")
    patches = series(t).select(
        "series", (s % 5).alias("idx"), F.when(s % 2 == 0, 100.0).alias("time"),
        F.lit(0.7).alias("gain"), F.lit(None).cast("string").alias("easing"),
    )
    return K.patch_rows(placed(t), patches, "series").select(*COLS)


INSERT_SQL = f"""{NORMAL_SQL}, {SERIES_SQL},
    fresh as (select series, case when series % 10 = 9 then 'nan'::double
            when series % 2 = 0 then 200.0 else -3.0 end as time,
        0.9::double as gain, 'hold' as easing, -1 - series as ord, 1 as pushed from series),
    both_rows as (select series, time, gain, easing, ord, 0 as pushed from nk
        union all select series, time, gain, easing, ord, pushed from fresh),
    {settle_sql('both_rows', 'ins')}"""


def fresh(t):
    s = c("series")
    time = F.when(s % 10 == 9, F.lit(float("nan"))).when(s % 2 == 0, 200.0).otherwise(-3.0)
    return series(t).select(
        "series", time.alias("time"), F.lit(0.9).alias("gain"), F.lit("hold").alias("easing"),
        (-1 - s).alias("ord"),
    )


@query("insert_row", f"with {INSERT_SQL} select series, time, gain, easing, ord, idx from ins")
def _(t):
    return K.insert_rows(in_order(t), fresh(t), "series").select(*COLS)


@query(
    "inserted_index",
    f"""with {INSERT_SQL} select f.series, f.ord, coalesce(i.idx, -1) as idx from fresh f
    left join ins i on i.series = f.series and i.time = greatest(0.0::double, f.time)""",
)
def _(t):
    new = fresh(t)
    return K.inserted_index(K.insert_rows(in_order(t), new, "series"), new, "series")


@query(
    "delete_rows",
    f"""with {NORMAL_SQL} select series, time, gain, easing, ord,
        row_number() over (partition by series order by time) - 1 as idx
    from nk where idx % 3 <> 1""",
)
def _(t):
    rows = placed(t)
    return K.delete_rows(rows, rows.df.where("idx % 3 = 1"), "series").select(*COLS)


@query("clear_groups", f"with {NORMAL_SQL} select series, ord from nk where series % 4 <> 2")
def _(t):
    cleared = series(t).where("series % 4 = 2")
    return K.clear_groups(normal(t), cleared, "series").select("series", "ord")


SHIFT_SQL = f"""{NORMAL_SQL}, moved as (select series,
        case when idx % 4 = 1 then greatest(0.0::double, time - 30.25) else time end as time,
        gain, easing, ord, 0 as pushed from nk),
    {settle_sql('moved', 'sn')}"""


def moved(t):
    rows = placed(t)
    shifts = rows.df.where("idx % 4 = 1").select("series", "idx", F.lit(-30.25).alias("delta"))
    return rows, shifts


@query("shift_rows", f"with {SHIFT_SQL} select series, time, gain, easing, ord, idx from sn")
def _(t):
    rows, shifts = moved(t)
    return K.shift_rows(rows, shifts, "series").select(*COLS)


@query(
    "reresolve_by_value",
    f"""with {SHIFT_SQL},
    want as (select series, idx as ref, greatest(0.0::double, time - 30.25) as at, gain, easing
        from nk where idx % 4 = 1)
    select w.series, w.ref, min(s.idx) as idx from want w join sn s on w.series = s.series
        and w.gain = s.gain and w.easing = s.easing and abs(s.time - w.at) < 1e-6
    group by all""",
)
def _(t):
    rows, shifts = moved(t)
    settled = K.shift_rows(rows, shifts, "series")
    want = rows.df.where("idx % 4 = 1").select(
        "series", c("idx").alias("ref"),
        F.greatest(F.lit(0.0), c("time") - 30.25).alias("time"), "gain", "easing",
    )
    return K.reresolve_by_value(settled, want, "series")


@query(
    "add_fade",
    f"""with {NORMAL_SQL},
    req as (select *, case series % 3 when 0 then 'in' when 1 then 'out' else 'duplicate' end as kind,
        series % 4 as source from nk),
    same as (select series, time,
            case when kind = 'in' and idx = 0 and time < 0.001 then 0.0
                when kind = 'in' and idx = source then 1.0 else gain end as gain,
            case when kind = 'in' and idx = 0 and time < 0.001 then 'linear' else easing end
                as easing, ord, 0 as pushed from req),
    added as (select series, 0.0::double as time, 0.0::double as gain, 'linear' as easing, ord,
            1 as pushed from req where kind = 'in' and idx = 0 and time >= 0.001
        union all select series, least(time + 2, greatest(time, 600.0)), 0.0, 'linear', ord, 1
            from req where kind = 'out' and idx = source
        union all select series, least(greatest(0.0, case when 50.0 > time + 1e-6 then 50.0
                else time + 1 end), greatest(0.0, 600.0)), gain, easing, ord, 1
            from req where kind = 'duplicate' and idx = source),
    allrows as (select * from same union all select * from added),
    {settle_sql('allrows', 'fn')}
    select series, time, gain, easing, ord, idx from fn""",
)
def _(t):
    s = c("series")
    requests = series(t).select(
        "series", (s % 4).alias("source"),
        F.when(s % 3 == 0, "in").when(s % 3 == 1, "out").otherwise("duplicate").alias("kind"),
        F.lit(50.0).alias("playhead"), F.lit(600.0).alias("duration"),
    )
    return K.add_fades(placed(t), requests, "series").select(*COLS)


@query(
    "clamped_shift",
    f"""with {NORMAL_SQL}, b as (select series, min(time) as lo, max(time) as hi,
        (series % 9 - 4) * 20.0 as delta, case when series % 8 = 0 then 0.0 else 720.0 end as d
        from nk where idx % 2 = 1 group by series)
    select series, (case when d <= 0 then 0.0 when delta < -lo then -lo
        when delta > d - hi then d - hi else delta end)::double as delta from b""",
)
def _(t):
    s = c("series")
    duration = F.when(s % 8 == 0, 0.0).otherwise(720.0)
    return K.clamped_shift(numbered(t).where("idx % 2 = 1"), "series", (s % 9 - 4) * 20.0, duration)


@query(
    "encode_keyframes",
    f"""with {NORMAL_SQL} select series, count(*) as items, string_agg(cast(floor(time * 100 + 0.5) as bigint) || ',' ||
            cast(floor(gain * 100 + 0.5) as bigint) || ',' ||
            case easing when 'hold' then 1 else 0 end, ',' order by time) as flat, null::varchar as reason
    from nk group by series""",
)
def _(t):
    lists = K.encode_keyframes(normal(t), "series")
    return lists.select("series", "items", F.array_join("flat", ",").alias("flat"), "reason")


@query(
    "stale_keys",
    """select distinct o_custkey as series from orders
    except select distinct user_id from events""",
)
def _(t):
    current = t.orders.select(c("o_custkey").alias("series"))
    return K.stale_keys(current, t.events.select(c("user_id").alias("series")), "series")
