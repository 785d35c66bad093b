"""The test tables read as keyframes, tracks and sample blocks, and the same in SQL.

``events`` are keyframes of the series ``user_id``; ``embeddings`` are sample buffers of
the mix ``label``; ``customer`` are tracks of the mix ``c_nationkey``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from timelane.session import epoch_micros

c = F.col

START = 1704067200000000  # 2024-01-01, the first day of the events
HOUR = 3_600_000_000
BLOCK = 16
RATE = 16.0


def micros():
    return epoch_micros(c("ts")) - F.lit(START).cast("bigint")


# Untidy keyframes: whole hours (many equal), some before 0, some not finite.


def raw_keyframes(t):
    time = F.floor(micros() / HOUR).cast("double") - 24
    return t.events.select(
        c("user_id").alias("series"),
        F.when(c("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(time).alias("time"),
        F.when(c("event_id") % 77 == 0, F.lit(float("inf")))
        .otherwise(c("value") / 100 - 0.05).alias("gain"),
        F.when(c("event_type") == "error", "hold")
        .when(c("event_type") == "view", "HOLD").otherwise("linear").alias("easing"),
        c("event_id").alias("ord"),
    )


RAW_SQL = f"""raw as (select user_id as series,
        case when event_id % 50 = 0 then 'nan'::double
            else ((epoch_us(ts) - {START}) // {HOUR})::double - 24 end as time,
        case when event_id % 77 = 0 then 'inf'::double else value / 100 - 0.05 end as gain,
        case event_type when 'error' then 'hold' when 'view' then 'HOLD' else 'linear' end as easing,
        event_id as ord, 0 as pushed from events)"""


def settle_sql(src: str, out: str, key: str = "series") -> str:
    """Common table expressions that bring ``src`` into normal form as ``out``."""
    return f"""{out}_c as (select {key}, greatest(0.0::double, time) as time,
            greatest(0.0::double, least(1.5::double, gain)) as gain,
            case when easing = 'hold' then 'hold' else 'linear' end as easing, ord, pushed
        from {src} where not isnan(time) and not isinf(time) and not isnan(gain)
            and not isinf(gain)),
    {out}_d as (select *, lead(time) over (partition by {key} order by time, pushed, ord) as nxt
        from {out}_c),
    {out} as (select {key}, time, gain, easing, ord,
            row_number() over (partition by {key} order by time, pushed, ord) - 1 as idx
        from {out}_d where nxt is null or nxt - time >= 1e-9)"""


NORMAL_SQL = f"{RAW_SQL}, {settle_sql('raw', 'nk')}"


def blocks(t):
    """Sample blocks of 16 values."""
    at = F.explode(F.sequence(F.lit(0), F.size("embedding") - 1, F.lit(BLOCK))).alias("start")
    return t.embeddings.select("label", "vec_id", "embedding", at).select(
        c("label").alias("mix"), c("vec_id").alias("track"),
        c("start").cast("bigint").alias("start"),
        F.slice("embedding", c("start") + 1, F.lit(BLOCK)).alias("values"),
    )


def tracks(t):
    v = c("vec_id")
    return t.embeddings.select(
        c("label").alias("mix"), v.alias("track"), (v % 16 / 10.0).alias("gain"),
        (((v * 37) % 201 - 100) / 100.0).alias("pan"), (v % 5 == 0).alias("muted"),
        ((v % 7 == 0) & (c("label") % 3 == 0)).alias("solo"),
    )


TRACKS_SQL = """tracks as (select label as mix, vec_id as track, (vec_id % 16) / 10.0::double as gain,
        ((vec_id * 37) % 201 - 100) / 100.0::double as pan, vec_id % 5 = 0 as muted,
        vec_id % 7 = 0 and label % 3 = 0 as solo from embeddings)"""

SAMPLES_SQL = """samples as (select label as mix, vec_id as track, i - 1 as frame,
        embedding[i]::double as value
        from (select label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i
            from embeddings))"""


def track_keyframes(t):
    """Keyframes of the tracks on a grid of 1/720 of four seconds, not yet normal."""
    quarter = F.floor(micros() / (HOUR // 4)).cast("double")
    rows = t.events.select(
        c("user_id").alias("track"), (quarter / 720.0).alias("time"),
        (c("value") / 100).alias("gain"),
        F.when(c("event_type") == "error", "hold").otherwise("linear").alias("easing"),
        c("event_id").alias("ord"),
    )
    mixes = t.embeddings.select(c("label").alias("mix"), c("vec_id").alias("track"))
    return rows.join(mixes, "track")


TRACK_KF_SQL = f"""traw as (select user_id as track,
        ((epoch_us(ts) - {START}) // {HOUR // 4})::double / 720.0::double as time,
        value / 100 as gain,
        case event_type when 'error' then 'hold' else 'linear' end as easing,
        event_id as ord, 0 as pushed from events),
    {settle_sql('traw', 'tk', 'track')}"""


def members(t):
    """Customers as tracks of a nation's mix."""
    k = c("c_custkey")
    return t.customer.select(
        c("c_nationkey").alias("mix"), k.alias("track"),
        (F.abs("c_acctbal") / 10000).alias("gain"), ((k % 21 - 10) / 10.0).alias("pan"),
        (c("c_acctbal") < 1000).alias("muted"),
        ((k % 11 == 0) & (c("c_nationkey") % 4 == 0)).alias("solo"),
    )


MEMBERS_SQL = """members as (select c_nationkey as mix, c_custkey as track,
        abs(c_acctbal) / 10000 as gain, (c_custkey % 21 - 10) / 10.0::double as pan,
        c_acctbal < 1000 as muted, c_custkey % 11 = 0 and c_nationkey % 4 = 0 as solo
        from customer)"""

PLACED_SQL = f"""{MEMBERS_SQL},
    numbered as (select *, row_number() over (partition by mix order by track) - 1 as idx
        from members),
    placed as (select *, idx // 2 + 1 as pair, case when idx % 2 = 0 then 'L' else 'R' end as side
        from numbered)"""
