"""Saved state: JSON and base64 texts built from orders and events, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelane.operators import mix as M
from timelane.operators.keyframes import encode_keyframes
from timelane.plans.inputs import NORMAL_SQL, PLACED_SQL, members
from timelane.plans.keyframes import normal
from timelane.plans.registry import query
from timelane.session import scratch_path, widen
from timelane.sources import state as S

c = F.col
KEY = "o_orderkey"


def nth(values, n):
    return F.get(F.array(*values), (n % len(values)).cast("int"))


def _state_text(k):
    """A state of ``1 + k % 4`` pairs with deliberately odd members."""
    n = k % 4 + 1
    pairs = F.sequence(F.lit(1).cast("bigint"), n)

    def listed(values):
        return F.array_join(F.transform(pairs, lambda i: nth([F.lit(v) for v in values], k + i)), ",")

    m = listed(["1", "0", "true", '"x"', '""', "null"])
    g = listed(["100", "75", '"loud"', "150", "null"])
    p = listed(["-100", "40", "null", '"wide"'])
    a = listed(["0", "[0,100,0,250,50,1]", "null", "[-1,5]", "[10,20]", '["5",1,2]', "[]",
                "[300,20,1,300,40,0,-50,999,1]"])
    v = nth([F.lit('"v":2,'), F.lit(""), F.lit('"v":1,')], k)
    auto = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(',"a":['), a, F.lit("]")))
    return F.concat(
        F.lit("{"), v, F.lit('"m":['), m, F.lit('],"g":['), g, F.lit('],"p":['), p,
        F.lit('],"M":'), (k % 151).cast("string"), auto, F.lit("}"),
    )


# The same members by number, for the SQL twin.
STATE_SQL = """base as (select o_orderkey, unnest(range(1, o_orderkey % 4 + 2)) as i from orders),
    vals as (select o_orderkey, i,
        [1, 0, 1, 1, 0, 0][(o_orderkey + i) % 6 + 1] as m,
        [100, 75, 100, 150, 100][(o_orderkey + i) % 5 + 1] as g,
        [-100, 40, 0, 0][(o_orderkey + i) % 4 + 1] as p,
        case when o_orderkey % 3 <> 0 then (o_orderkey + i) % 8 else 0 end as a from base),
    state as (select o_orderkey, string_agg(m, ',' order by i) as m, string_agg(g, ',' order by i) as g,
        string_agg(p, ',' order by i) as p, (o_orderkey % 151)::double as master,
        bool_or(a in (3, 4, 5)) as legacy_dropped,
        o_orderkey % 3 <> 0 and bool_or(a in (1, 7)) as legacy_v1 from vals group by o_orderkey)"""


def _flat(s):
    def ints(x):
        return F.array_join(F.transform(x, lambda v: v.cast("bigint").cast("string")), ",")

    return [
        ints(s["m"]).alias("m"), ints(s["g"]).alias("g"), ints(s["p"]).alias("p"),
        s["master"].alias("master"), s["legacy_dropped"].alias("legacy_dropped"),
        s["legacy_v1"].alias("legacy_v1"),
    ]


TWO_STATES = "#s=eyJ2IjoyLCJtIjpbMV0sImciOlsxXSwicCI6WzFdLCJNIjoxfXt9"  # a state and "{}" behind it


def _broken(k, text):
    """Every seventh text is broken in some way."""
    return F.when(k % 7 != 0, text).otherwise(
        nth([F.lit("not base64!"), F.lit("s="), F.lit("#s=e30"), F.lit(""), F.lit(TWO_STATES)], k)
    )


@query(
    "read_compact_state",
    f"""with {STATE_SQL} select o.o_orderkey, s.m, s.g, s.p, s.master, s.legacy_dropped, s.legacy_v1
    from orders o left join state s on s.o_orderkey = o.o_orderkey and o.o_orderkey % 7 <> 0""",
)
def _(t):
    k = c(KEY)
    link = F.concat(
        nth([F.lit("#s="), F.lit("x=1&s="), F.lit("")], k), S.write_compact_state(_state_text(k)),
        nth([F.lit(""), F.lit("&y=2"), F.lit("")], k),
    )
    rows = widen(t.orders).select(KEY, S.read_compact_state(_broken(k, link)).alias("s"))
    return rows.select(KEY, *_flat(c("s")))


@query(
    "decode_keyframes",
    f"""with {STATE_SQL},
    lists as (select o_orderkey, i, a, case a when 1 then [(0.0, 1.0, 'linear'), (2.5, 0.5, 'hold')]
        when 7 then [(0.0, 1.5, 'hold'), (3.0, 0.4, 'linear')] end as l from vals),
    rows as (select o_orderkey, i, unnest(l) as k from lists where l is not null)
    select o_orderkey, i as pair, k[1]::double as time, k[2]::double as gain, k[3] as easing
    from rows""",
)
def _(t):
    s = S.decode_state(F.try_parse_json(_state_text(c(KEY))))
    pairs = widen(t.orders).select(KEY, s.alias("s")).select(
        KEY, F.posexplode("s.automation").alias("n", "keyframes")
    )
    rows = pairs.select(KEY, (c("n") + 1).cast("bigint").alias("pair"), F.explode("keyframes").alias("k"))
    return rows.select(KEY, "pair", "k.time", "k.gain", "k.easing")


@query(
    "coerce_ints",
    f"""with {STATE_SQL} select o_orderkey, i as pair, m::integer as m, g::double as g,
        p::double as p from vals""",
)
def _(t):
    s = S.decode_state(F.try_parse_json(_state_text(c(KEY)))).alias("s")
    zipped = F.posexplode(F.arrays_zip("s.m", "s.g", "s.p")).alias("n", "x")
    rows = widen(t.orders).select(KEY, s).select(KEY, zipped)
    return rows.select(KEY, (c("n") + 1).cast("bigint").alias("pair"), "x.m", "x.g", "x.p")


@query(
    "version_gate",
    f"""with {STATE_SQL} select o_orderkey,
        legacy_v1 and o_orderkey % 3 <> 0 as warned from state""",
)
def _(t):
    s = S.decode_state(F.try_parse_json(_state_text(c(KEY))))
    return widen(t.orders).select(KEY, s["legacy_v1"].alias("warned"))


def _mix_text(k, status, price):
    state = _state_text(k)
    name = F.concat(F.lit("track_"), k.cast("string"), F.lit(".awc"))
    good = S.mix_file_json(
        name, F.floor(price).cast("bigint"), k % 9, F.lit(48000), state, F.lit("2024-01-01T00:00:00Z")
    )
    return (
        F.when(k % 22 == 1, F.lit("{oops"))
        .when(k % 44 == 12, F.concat(good, F.lit(" trailing")))
        .when(k % 44 == 34, F.concat(good, good))
        .when(k % 11 == 2, F.lit("[1,2]"))
        .when(k % 11 == 3, F.regexp_replace(good, '"awc-mix"', '"other"'))
        .when(k % 11 == 4, F.regexp_replace(good, '"version":2', '"version":1'))
        .when(k % 11 == 5, F.regexp_replace(good, '"version":2', '"version":99'))
        .when(k % 11 == 6, F.regexp_replace(good, '"awc":', '"was":'))
        .when(k % 11 == 7, F.regexp_replace(good, '"state":', '"was":'))
        .when(k % 11 == 8, F.regexp_replace(good, '"streamCount":', '"extra":'))
        .otherwise(good)
    )


MIX_ERRORS = (
    "case o.o_orderkey % 11 when 1 then 'invalid_json' when 2 then 'not_object' when 3 then 'format'"
    " when 4 then 'version_1' when 5 then 'version' when 6 then 'meta' when 7 then 'state' end"
)


@query(
    "read_mix_files",
    f"""with {STATE_SQL} select o.o_orderkey, {MIX_ERRORS} as error,
        'track_' || o.o_orderkey || '.awc' as name, cast(floor(o_totalprice) as bigint) as size,
        case when o.o_orderkey % 11 = 8 then 0 else o.o_orderkey % 9 end as stream_count, s.m, s.g, s.p, s.master
    from orders o join state s on s.o_orderkey = o.o_orderkey where ({MIX_ERRORS}) is null
    union all select o.o_orderkey, {MIX_ERRORS}, null, null, null, null, null, null, null
    from orders o where ({MIX_ERRORS}) is not null""",
)
def _(t):
    text = _mix_text(c(KEY), c("o_orderstatus"), c("o_totalprice"))
    mix = widen(t.orders).select(KEY, S.parse_mix_file(text).alias("x"))
    ok = c("x.error").isNull()
    flat = mix.select(KEY, "x.error", "x.name", "x.size", "x.stream_count", *_flat(c("x.state")))
    return flat.select(
        KEY, "error",
        *[F.when(c("error").isNull(), c(n)).alias(n)
          for n in ("name", "size", "stream_count", "m", "g", "p", "master")],
    )


@query(
    "write_mix_files",
    """select o_orderkey, '{"format":"awc-mix","version":2,"awc":{"name":"track_' || o_orderkey ||
        '.awc","size":' || cast(floor(o_totalprice) as bigint) || ',"streamCount":' || o_orderkey % 9 ||
        ',"sampleRate":48000},"state":{"v":2,"m":[1],"g":[' || o_orderkey % 151 || '],"p":[0],"M":100},'
        || '"savedAt":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '","appVersion":"0.1.0"}'
        as value from orders""",
)
def _(t):
    k = c(KEY)
    state = S.state_json(
        F.array(F.lit(1)), F.array(k % 151), F.array(F.lit(0)), F.lit(100)
    )
    text = S.mix_file_json(
        F.concat(F.lit("track_"), k.cast("string"), F.lit(".awc")),
        F.floor("o_totalprice").cast("bigint"), k % 9, F.lit(48000), state,
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )
    return t.orders.select(KEY, text.alias("value"))


@query(
    "mix_files_round_trip",
    f"""with {STATE_SQL} select null as error, 'track_' || o.o_orderkey || '.awc' as name, s.m, s.g, s.p, s.master
    from orders o join state s on s.o_orderkey = o.o_orderkey where ({MIX_ERRORS}) is null
    union all select {MIX_ERRORS}, null, null, null, null, null from orders o where ({MIX_ERRORS}) is not null""",
)
def _(t):
    path = scratch_path(t.spark)
    text = _mix_text(c(KEY), c("o_orderstatus"), c("o_totalprice"))
    S.write_mix_files(t.orders.select(text.alias("value")).repartition(7), path)
    flat = S.read_mix_files(t.spark, path).select("error", "name", *_flat(c("state")))
    return flat.select("error", *[F.when(c("error").isNull(), c(n)).alias(n) for n in ("name", "m", "g", "p", "master")])


@query(
    "write_compact_state",
    f"""with {PLACED_SQL}, lefts as (select mix, pair, max(case when side = 'L' then
            struct_pack(gain, pan, muted) end) as x from placed group by mix, pair),
    vals as (select mix, pair, case when not x.muted then 1 else 0 end as m,
        cast(floor(x.gain * 100 + 0.5) as bigint) as g,
        cast(floor(abs(x.pan) * 100 + 0.5) as bigint) as p from lefts),
    js as (select mix, '{{"v":2,"m":[' || string_agg(m, ',' order by pair) || '],"g":[' ||
        string_agg(g, ',' order by pair) || '],"p":[' || string_agg(p, ',' order by pair) ||
        '],"M":80}}' as j from vals group by mix)
    select mix, rtrim(to_base64(encode(j)), '=') as payload, null::varchar as reason from js""",
)
def _(t):
    placed = M.positions(members(t), "mix", "track")
    lists = M.compact_lists(M.compact_state(placed, "mix"), "mix")
    text = S.state_json(c("m"), c("g"), c("p"), F.lit(80))
    return lists.select("mix", S.write_compact_state(text).alias("payload"), "reason")


@query(
    "compact_state_round_trip",
    f"""with {PLACED_SQL}, lefts as (select mix, pair, max(case when side = 'L' then
            struct_pack(gain, pan, muted) end) as x from placed group by mix, pair)
    select mix, pair, pair * 2 as left_track, pair * 2 + 1 as right_track, not x.muted as enabled,
        floor(x.gain * 100 + 0.5) / 100 as gain, floor(abs(x.pan) * 100 + 0.5) / 100 as spread
    from lefts""",
)
def _(t):
    state = M.compact_state(M.positions(members(t), "mix", "track"), "mix")
    text = S.state_json(c("m"), c("g"), c("p"), F.lit(80))
    saved = M.compact_lists(state, "mix").select(
        "mix", S.read_compact_state(F.concat(F.lit("#s="), S.write_compact_state(text))).alias("state"))
    pairs = state.select("mix", "pair", (c("pair") * 2).alias("left_track"), (c("pair") * 2 + 1).alias("right_track"))
    return S.apply_mix(saved, pairs)


@query(
    "automation_round_trip",
    f"""with {NORMAL_SQL} select series, count(*) as keyframes,
        sum(floor(time * 100 + 0.5)) / 100 as time_sum, sum(case easing when 'hold' then 1 else 0 end)::bigint
            as holds from nk group by series""",
)
def _(t):
    lists = encode_keyframes(normal(t), "series")
    text = F.concat(F.lit("["), F.array_join("flat", ","), F.lit("]"))
    back = S.decode_entry(F.try_parse_json(text))["keyframes"]
    total = F.aggregate(c("k"), F.lit(0.0), lambda a, x: a + F.floor(x["time"] * 100 + 0.5))
    holds = F.size(F.filter("k", lambda x: x["easing"] == "hold")).cast("bigint")
    return lists.select("series", back.alias("k")).select(
        "series", F.size("k").cast("bigint").alias("keyframes"),
        (total / 100).alias("time_sum"), holds.alias("holds"),
    )


def _pairs(t):
    return t.lineitem.groupBy(c("l_orderkey").alias("mix"), c("l_linenumber").cast("bigint").alias("pair")).agg(
        F.min("l_partkey").alias("left_track"), F.max("l_suppkey").alias("right_track")
    )


PAIRS_SQL = """pairs as (select l_orderkey as mix, l_linenumber::bigint as pair,
        min(l_partkey) as left_track, max(l_suppkey) as right_track from lineitem group by 1, 2),
    counted as (select mix, count(*) as n from pairs group by mix)"""


def _saved(t):
    s = S.decode_state(F.try_parse_json(_state_text(c(KEY))))
    return widen(t.orders).select(c(KEY).alias("mix"), (c(KEY) % 9).alias("stream_count"), s.alias("state"))


@query(
    "apply_mix",
    f"""with {STATE_SQL}, {PAIRS_SQL} select p.mix, p.pair, p.left_track, p.right_track,
        v.m = 1 as enabled, v.g / 100.0::double as gain, abs(v.p / 100.0::double) as spread
    from pairs p join counted n on n.mix = p.mix join vals v on v.o_orderkey = p.mix and v.i = p.pair
    where p.pair <= n.n""",
)
def _(t):
    return S.apply_mix(_saved(t), _pairs(t))


@query(
    "apply_warnings",
    f"""with {PAIRS_SQL} select mix, case when o_orderkey % 4 + 1 <> n then 'pair_mismatch'
        when (o_orderkey % 9 + 1) // 2 <> n then 'stream_mismatch' end as warning
    from orders join counted on mix = o_orderkey""",
)
def _(t):
    return S.apply_warnings(_saved(t), _pairs(t))


@query(
    "loaded_wrong_file",
    """select o_orderkey, coalesce(a <> '' and a <> o_orderstatus, false) as wrong
    from (select *, case o_orderkey % 4 when 0 then '' when 1 then null else 'F' end as a from orders)""",
)
def _(t):
    saved = F.when(c(KEY) % 4 == 0, "").when(c(KEY) % 4 != 1, "F")
    return t.orders.select(KEY, S.loaded_wrong_file(saved, c("o_orderstatus")).alias("wrong"))


@query(
    "settings_defaults",
    """with k as (select event_id, cast(regexp_extract(props, '(\\d+)', 1) as bigint) as k from events)
    select event_id,
        case when k % 8 = 7 then 'tangerine' when k % 3 = 0 then 'lime' else 'tangerine' end as accent,
        case when event_id % 9 = 4 then true when k % 8 = 7 then false
            when k % 4 = 0 then true else false end as "reduceMotion",
        k % 8 <> 7 and k % 5 = 1 as "autoplayOnLoad",
        case when event_id % 9 = 4 then 12.5 when k % 8 = 7 or k * 2 > 150 then 100.0 else k * 2.0
            end::double as "defaultMasterPct"
    from k""",
)
def _(t):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    text = F.concat(
        F.lit('{"accent":'), nth([F.lit('"lime"'), F.lit('"plaid"'), F.lit("7")], k),
        F.lit(',"reduceMotion":'), nth([F.lit("true"), F.lit('"yes"'), F.lit("false"), F.lit("1")], k),
        F.lit(',"autoplayOnLoad":'), F.when(k % 5 == 1, "true").otherwise("null"),
        F.lit(',"defaultMasterPct":'), (k * 2).cast("string"), F.lit("}"),
    )
    settings = S.settings_with_defaults(F.when(k % 8 == 7, F.lit("nope")).otherwise(text))
    patched = c("event_id") % 9 == 4
    patch = F.struct(
        F.lit(None).cast("string").alias("accent"),
        F.when(patched, True).alias("reduceMotion"),
        F.lit(None).cast("boolean").alias("autoplayOnLoad"),
        F.when(patched, 12.5).alias("defaultMasterPct"),
    )
    rows = t.events.select("event_id", settings.alias("s"), patch.alias("p"))
    return rows.select("event_id", S.patch_settings(c("s"), c("p")).alias("x")).select("event_id", "x.*")
