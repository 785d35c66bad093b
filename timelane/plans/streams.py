"""Meters and gates on events: batch queries, and streams run over the same file."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timelane.functions.scalars import fixed
from timelane.operators import gates as G
from timelane.plans.inputs import START, micros
from timelane.plans.registry import query
from timelane.session import epoch_micros
from timelane.streaming import operators as O
from timelane.streaming.runner import dripped, run_available, run_upserts

c = F.col


def frames(t):
    """Events as meter frames: an hour of the table is a second of sound."""
    return t.events.select(
        c("user_id").alias("series"), c("event_id").alias("ord"),
        (micros() / 3.6e9).alias("at"), F.floor(micros() / 3_600_000).alias("ts_ms"),
        (c("value") / 100).alias("peak"), (c("value") / 100).alias("position"),
    )


def _fold_sql(first: str, then: str, columns: str) -> str:
    """Row by row over each series; ``then`` may use the row ``r`` and the state ``f``."""
    return f"""with recursive r as (select user_id as series, event_id as ord,
            (epoch_us(ts) - {START}) / 3.6e9 as tm, (epoch_us(ts) - {START}) // 3600000 as ts_ms,
            value / 100 as peak,
            row_number() over (partition by user_id order by ts, event_id) as n from events),
        f as (select series, ord, n, {first} from r where n = 1
            union all select r.series, r.ord, r.n, {then} from f join r
                on r.series = f.series and r.n = f.n + 1)
    select {columns}"""


@query(
    "peak_hold",
    _fold_sql(
        "peak as hold, tm + 1.0 as expires, tm as last",
        """case when r.peak >= f.hold then r.peak when r.tm > f.expires
            then greatest(r.peak, f.hold - 0.6 * (r.tm - f.last)) else f.hold end,
        case when r.peak >= f.hold then r.tm + 1.0 else f.expires end, r.tm""",
        "series, ord, floor(hold * 1e6 + 0.5) / 1e6 as hold from f",
    ),
)
def _(t):
    held = G.peak_hold(frames(t), "series", ["at", "ord"])
    return held.select("series", "ord", fixed(c("hold")).alias("hold"))


@query(
    "throttle",
    _fold_sql(
        "ts_ms as last, true as passed",
        "case when r.ts_ms - f.last >= 8000 then r.ts_ms else f.last end, r.ts_ms - f.last >= 8000",
        "series, ord from f where passed",
    ),
)
def _(t):
    rows = frames(t).select("series", "ord", "ts_ms")
    return G.throttle(rows, "series", ["ts_ms", "ord"], gap_ms=8000).select("series", "ord")


@query(
    "delta_filter",
    _fold_sql(
        "peak as last, true as passed",
        "case when abs(r.peak - f.last) >= 0.1 then r.peak else f.last end, abs(r.peak - f.last) >= 0.1",
        "series, ord from f where passed",
    ),
)
def _(t):
    rows = frames(t).select("series", "ord", "ts_ms", "position")
    return G.delta_filter(rows, "series", ["ts_ms", "ord"], least=0.1).select("series", "ord")


@query(
    "debounce",
    f"""with r as (select user_id as series, event_id as ord, (epoch_us(ts) - {START}) // 3600000 as ts_ms
        from events)
    select series, ord, ts_ms from (select *, lead(ts_ms) over (partition by series order by ts_ms, ord)
        as nxt from r) where nxt is null or nxt - ts_ms > 4000""",
)
def _(t):
    return G.debounce(frames(t).select("series", "ord", "ts_ms"), "series", quiet_ms=4000)


LEVELS_SQL = """select event_type, epoch_us(time_bucket(interval '6 hours', ts)) // 1000000 as start,
        max(abs(value)) as peak, floor(sqrt(sum(value * value) / count(*)) * 1e6 + 0.5) / 1e6 as rms,
        count(*) as frames from events"""


def _timed(df):
    """Zone-less times as instants; the tables are in UTC."""
    return df.withColumn("ts", F.timestamp_micros(epoch_micros(c("ts"))))


def _levels(df):
    return df.select(
        "event_type", F.unix_seconds("start").alias("start"), "peak",
        fixed(c("rms")).alias("rms"), "frames",
    )


@query("level_by_time", LEVELS_SQL + " group by all")
def _(t):
    return _levels(G.level_by_time(_timed(t.events), "event_type", "6 hours"))


def _stream(t):
    schema = t.events.schema
    source = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return _timed(source.parquet(t.folder))


@query(
    "stream_levels",
    LEVELS_SQL + """ where time_bucket(interval '6 hours', ts) + interval '6 hours'
        <= (select max(ts) - interval '10 minutes' from events) group by all""",
)
def _(t):
    return _levels(run_available(O.stream_levels(_stream(t), "event_type", "6 hours"), "levels"))


@query(
    "stream_debounce",
    """with r as (select user_id as series, event_id, ts,
            lead(ts) over (partition by user_id order by ts, event_id) as nxt from events)
    select series, event_id from r where (nxt is null or nxt - ts > interval '4 hours')
        and ts + interval '4 hours' <= (select max(ts) - interval '10 minutes' from events)""",
)
def _(t):
    rows = _stream(t).select(c("user_id").alias("series"), "ts", c("event_id").alias("ord"))
    out = run_available(O.stream_debounce(rows, "series", "4 hours"), "debounce")
    return out.select("series", c("ord").alias("event_id"))


# Streams of several micro-batches. A row comes up to 11 hours after rows that follow it, and the
# watermark waits for 12.

DELAY, SLICES, DAY = "12 hours", 3, 86_400_000_000
LATEST_SQL = "(select epoch_us(max(ts)) // 1000 - 43200000 from events)"


def _shuffled(df, name: str, *by: str):
    """``df`` (with ``ts``) as a stream whose rows are out of order within the watermark."""
    late = F.pmod(F.xxhash64(*by), F.lit(660)) * 60_000_000
    month = F.lit(30 * DAY / SLICES)
    place = F.floor((F.unix_micros("ts") - START + late) / month)
    return dripped(df, F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), place)), SLICES, name)


def _frame_stream(t, name: str):
    rows = _timed(t.events).select(
        c("user_id").alias("series"), "ts", c("event_id").alias("ord"),
        (micros_of("ts") / 3.6e9).alias("at"), F.floor(micros_of("ts") / 3_600_000).alias("ts_ms"),
        (c("value") / 100).alias("peak"), (c("value") / 100).alias("position"),
    )
    return _shuffled(rows, name, "ord")


def micros_of(ts: str):
    return F.unix_micros(ts) - F.lit(START).cast("bigint")


def _stream_fold_sql(parts, columns: str) -> str:
    """Row by row over each series up to the watermark; (name, first, then) may use the row ``r``
    and the state ``f``. A day without rows starts anew."""
    first = ", ".join(f"{one} as {name}" for name, one, _ in parts)
    then = ", ".join(f"case when r.us - f.us > {DAY} then {one} else {two} end" for _, one, two in parts)
    return f"""with recursive r as (select user_id as series, event_id as ord, epoch_us(ts) as us,
            (epoch_us(ts) - {START}) / 3.6e9 as tm, (epoch_us(ts) - {START}) // 3600000 as ts_ms,
            value / 100 as peak, row_number() over (partition by user_id order by ts, event_id) as n
            from events where epoch_us(ts) <= 1000 * {LATEST_SQL}),
        f as (select r.series, r.ord, r.us, r.n, {first} from r where r.n = 1
            union all select r.series, r.ord, r.us, r.n, {then} from f join r
                on r.series = f.series and r.n = f.n + 1)
    select {columns}"""


@query(
    "stream_peak_hold",
    _stream_fold_sql(
        [("hold", "r.peak", """case when r.peak >= f.hold then r.peak when r.tm > f.expires
            then greatest(r.peak, f.hold - 0.6 * (r.tm - f.last)) else f.hold end"""),
         ("expires", "r.tm + 1.0", "case when r.peak >= f.hold then r.tm + 1.0 else f.expires end"),
         ("last", "r.tm", "r.tm")],
        "series, ord, floor(hold * 1e6 + 0.5) / 1e6 as hold from f",
    ),
)
def _(t):
    held = O.stream_fold(
        _frame_stream(t, "frames"), "series", ["ord"], G.peak_hold_step(), "hold double", DELAY)
    return run_available(held, "peaks").select("series", "ord", fixed(c("hold")).alias("hold"))


@query(
    "stream_throttle",
    _stream_fold_sql(
        [("last", "r.ts_ms", "case when r.ts_ms - f.last >= 8000 then r.ts_ms else f.last end"),
         ("passed", "true", "r.ts_ms - f.last >= 8000")],
        "series, ord from f where passed",
    ),
)
def _(t):
    passed = O.stream_fold(
        _frame_stream(t, "frames"), "series", ["ord"], G.throttle_step(8000), delay=DELAY)
    return run_available(passed, "throttled").select("series", "ord")


@query(
    "stream_delta_filter",
    _stream_fold_sql(
        [("last", "r.peak", "case when abs(r.peak - f.last) >= 0.1 then r.peak else f.last end"),
         ("passed", "true", "abs(r.peak - f.last) >= 0.1")],
        "series, ord from f where passed",
    ),
)
def _(t):
    passed = O.stream_fold(
        _frame_stream(t, "frames"), "series", ["ord"], G.delta_step(0.1), delay=DELAY)
    return run_available(passed, "moved").select("series", "ord")


GAP = 14_400_000


@query(
    "stream_coalesce",
    f"""with e as (select user_id as mix, event_id as ord, epoch_us(ts) as us, epoch_us(ts) // 1000 as ts_ms,
            case when event_id % 5 > 0 then (event_id // 3 % 2)::varchar end as edit_key, event_type as label
            from events where epoch_us(ts) <= 1000 * {LATEST_SQL}),
        m as (select *, lag(edit_key) over w as k, lag(ts_ms) over w as p, count(*) over w as n from e
            window w as (partition by mix order by us, ord)),
        runs as (select *, sum(case when edit_key = k and ts_ms - p <= {GAP} then 0 else 1 end) over
            (partition by mix order by n) as run from m),
        merged as (select mix, run, arg_min(ord, n)::varchar as state, arg_max(label, n) as label,
            arg_min(edit_key, n) filter (edit_key is not null) as edit_key, max(ts_ms) as pushed_ms,
            arg_min(ord, n) as first_ord, count(*) as merged from runs group by mix, run)
    select * exclude (run) from (select *, lead(run) over (partition by mix order by run) as nxt from merged)
        as x where nxt is not null or pushed_ms + {GAP} + 1 <= {LATEST_SQL}""".replace(
        "select * exclude (run)", "select mix, state, label, edit_key, pushed_ms, first_ord, merged"),
)
def _(t):
    key = F.when(c("event_id") % 5 > 0, (F.floor(c("event_id") / 3) % 2).cast("string"))
    rows = _timed(t.events).select(
        c("user_id").alias("mix"), "ts", F.unix_millis("ts").alias("ts_ms"), c("event_id").alias("ord"),
        key.alias("edit_key"), c("event_type").alias("label"), c("event_id").cast("string").alias("state"),
    )
    return run_available(O.stream_coalesce(_shuffled(rows, "edits", "ord"), "mix", GAP, DELAY), "coalesced")


@query(
    "stream_latest",
    """select user_id as series, arg_max(event_id, (ts, event_id)) as ord,
        arg_max(value, (ts, event_id)) as value from events group by user_id""",
)
def _(t):
    rows = _timed(t.events).select(c("user_id").alias("series"), "ts", c("event_id").alias("ord"), "value")
    latest = O.stream_latest(_shuffled(rows, "states", "ord"), "series", DELAY)
    return run_upserts(latest, "latest", "series", "ts", "ord").select("series", "ord", "value")


@query("stream_dedupe", "select event_id, user_id from events")
def _(t):
    """Every event comes twice, at different places of the stream."""
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")
    rows = _timed(t.events).select("event_id", "user_id", "ts", both)
    once = O.stream_dedupe(_shuffled(rows, "twice", "event_id", "copy"), "event_id", "1 day")
    return run_available(once, "once").select("event_id", "user_id")


@query(
    "stream_progress",
    """select user_id as job, count(*) as done, count(*) as total, true as finished,
        max(epoch_us(ts)) as last_us from events group by user_id""",
)
def _(t):
    """A user is a job, an event type a stem, and its events are the blocks as they get done."""
    stem = W.partitionBy("user_id", "event_type")
    sizes = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("blocks"))
    stems = sizes.groupBy("user_id").agg(F.count(F.lit(1)).alias("stems"))
    rows = _timed(t.events).withColumn("blocks_done", F.row_number().over(stem.orderBy("ts", "event_id")))
    rows = rows.join(sizes, ["user_id", "event_type"]).join(stems, "user_id").select(
        c("user_id").alias("job"), "ts", c("event_id").alias("ord"), c("event_type").alias("stem"),
        "blocks_done", "blocks", "stems",
    )
    progress = O.stream_progress(_shuffled(rows, "blocks", "ord"), "job", DELAY, "40 days")
    return run_upserts(progress, "progress", "job", "last_us", "done")


@query(
    "stream_retention",
    """select o_custkey, o_orderkey, o_orderdate, price from (select o_custkey, o_orderkey, o_orderdate,
            floor(o_totalprice)::bigint + case when o_orderkey % 5 = 0 then 1 else 0 end as price,
            row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders)
    where n <= 3""",
)
def _(t):
    """Orders are put in three batches, every fifth again in a fourth, where the later put wins."""
    price = F.floor("o_totalprice")
    batch = F.pmod(F.xxhash64("o_orderkey"), F.lit(3))
    puts = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", price.alias("price"), batch.alias("batch"))
    again = puts.where("o_orderkey % 5 = 0").withColumn("price", c("price") + 1).withColumn("batch", F.lit(3))
    rows = dripped(puts.unionByName(again), c("batch"), 4, "puts")
    return run_upserts(
        rows, "newest", "o_orderkey", "o_orderdate", "o_orderkey", keep=3, owner="o_custkey").drop("batch")
