"""Edit logs on events, sessions on orders, selections on lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelane.functions.scalars import fixed
from timelane.operators import history as H
from timelane.operators import selection as S
from timelane.operators import sessions as Z
from timelane.plans.inputs import START, micros
from timelane.plans.registry import query
from timelane.session import epoch_micros

c = F.col

# Edit log: milliseconds squeezed so that neighbours of a user often lie within the gap.
LOG_SQL = f"""log as (select user_id as mix, event_id as ord,
        (epoch_us(ts) - {START}) // 20000000 as ts_ms,
        case when event_type in ('view', 'click') then event_type
            when event_type = 'error' then null else 'other' end as edit_key,
        'edit ' || event_id as label, value as state from events)"""


def edit_log(t):
    key = (
        F.when(c("event_type").isin("view", "click"), c("event_type"))
        .when(c("event_type") != "error", "other")
    )
    return t.events.select(
        c("user_id").alias("mix"), c("event_id").alias("ord"),
        F.floor(micros() / 20_000_000).alias("ts_ms"), key.alias("edit_key"),
        F.concat(F.lit("edit "), c("event_id").cast("string")).alias("label"),
        c("value").alias("state"),
    )


# Two mixes of thousands of edits instead of many small ones: user_id parity.
RUNS_SQL = """flag as (select *, case when edit_key = lag(edit_key) over w
            and ts_ms - lag(ts_ms) over w <= 500 then 0 else 1 end as opens
        from log window w as (partition by mix order by ts_ms, ord)),
    run as (select *, sum(opens) over (partition by mix order by ts_ms, ord) as r from flag),
    merged as (select mix, first(state order by ts_ms, ord) as state,
            last(label order by ts_ms, ord) as label,
            first(edit_key order by ts_ms, ord) as edit_key, max(ts_ms) as pushed_ms,
            first(ord order by ts_ms, ord) as first_ord, count(*) as merged
        from run group by mix, r)"""


@query("coalesce_edits", f"with {LOG_SQL}, {RUNS_SQL} select * from merged")
def _(t):
    return H.coalesce_edits(edit_log(t), "mix")


@query(
    "coalesce_edits_two_logs",
    f"""with {LOG_SQL.replace('user_id as mix', 'user_id % 2 as mix')}, {RUNS_SQL}
    select * from merged""",
)
def _(t):
    return H.coalesce_edits(edit_log(t).withColumn("mix", c("mix") % 2), "mix")


@query(
    "cap_history",
    f"""with {LOG_SQL}, {RUNS_SQL}, n as (select *, row_number() over (partition by mix
        order by pushed_ms desc, first_ord desc) as n from merged)
    select mix, pushed_ms, first_ord, label from n where n <= 20""",
)
def _(t):
    capped = H.cap_history(H.coalesce_edits(edit_log(t), "mix"), "mix", keep=20)
    return capped.select("mix", "pushed_ms", "first_ord", "label")


_ENTRY = "struct(state varchar, label varchar, edit_key varchar, ts_ms bigint)[]"
_MERGES = """(len(f.p) > 0 and r.edit_key is not null and f.p[-1].edit_key is not distinct from r.edit_key
    and r.ts_ms - f.p[-1].ts_ms <= 500)"""


def _moved(source: str) -> str:
    """The last entry of a stack as it goes onto the other one."""
    return f"""[struct_pack(state := r.state, label := f.{source}[-1].label,
        edit_key := f.{source}[-1].edit_key, ts_ms := r.ts_ms)]"""


UNDO_SQL = f"""with recursive {{log}}, r as (select mix, ord, ts_ms, edit_key, label, state::varchar as state,
        case when ord % 7 in (2, 5) then 'undo' when ord % 7 = 3 then 'redo' when ord % 97 = 0 then 'clear'
            else 'push' end as op, row_number() over (partition by mix order by ts_ms, ord) as n from log),
    f as (select mix, 0::bigint as n, 0::bigint as ord, '' as op, []::{_ENTRY} as p, []::{_ENTRY} as q,
            null::varchar as restored from (select distinct mix from r)
        union all select r.mix, r.n, r.ord, r.op,
            case when r.op = 'clear' then []
                when r.op = 'undo' then case when len(f.p) > 0 then f.p[1:len(f.p) - 1] else f.p end
                when r.op = 'redo' then case when len(f.q) > 0 then list_concat(f.p, {_moved('q')}) else f.p end
                when {_MERGES} then list_concat(f.p[1:len(f.p) - 1], [struct_pack(state := f.p[-1].state,
                    label := r.label, edit_key := f.p[-1].edit_key, ts_ms := r.ts_ms)])
                else list_concat(f.p, [struct_pack(state := r.state, label := r.label,
                    edit_key := r.edit_key, ts_ms := r.ts_ms)])[greatest(1, len(f.p) - 98) : len(f.p) + 1] end,
            case when r.op in ('clear', 'push') then []
                when r.op = 'undo' then case when len(f.p) > 0 then list_concat(f.q, {_moved('p')}) else f.q end
                when len(f.q) > 0 then f.q[1:len(f.q) - 1] else f.q end,
            case when r.op = 'undo' and len(f.p) > 0 then f.p[-1].state
                when r.op = 'redo' and len(f.q) > 0 then f.q[-1].state end
        from f join r on r.mix = f.mix and r.n = f.n + 1)
    select mix, ord, op, len(p)::bigint as past, len(q)::bigint as future, restored from f where n > 0"""


@query("undo_redo", UNDO_SQL.format(log=LOG_SQL))
def _(t):
    n = c("ord") % 7
    op = (
        F.when(n.isin(2, 5), "undo").when(n == 3, "redo").when(c("ord") % 97 == 0, "clear")
        .otherwise("push")
    )
    log = edit_log(t).withColumn("op", op).withColumn("state", c("state").cast("string"))
    return H.undo_redo(log, "mix").select("mix", "ord", "op", "past", "future", "restored")


@query(
    "last_transport",
    f"""with s as (select user_id as series, event_id as ord, (epoch_us(ts) - {START}) / 1e6 as at,
            event_type in ('click', 'purchase') as playing, value - 50 as "offset"
            from events where event_type <> 'view'),
        p as (select event_id, user_id as series, (epoch_us(ts) - {START}) / 1e6 as at
            from events where event_type = 'view')
    select p.event_id, p.series, floor((case when s.playing
            then greatest(0.0, s."offset" + (p.at - s.at)) else s."offset" end) * 1e4 + 0.5) / 1e4
            as position
    from p asof left join s on p.series = s.series and p.at >= s.at""",
)
def _(t):
    at = (micros() / 1e6).alias("at")
    states = t.events.where("event_type <> 'view'").select(
        c("user_id").alias("series"), c("event_id").alias("ord"), at,
        c("event_type").isin("click", "purchase").alias("playing"),
        (c("value") - 50).alias("offset"),
    )
    views = t.events.where("event_type = 'view'").select(
        "event_id", c("user_id").alias("series"), at
    )
    found = H.last_transport(states, views, "series")
    return found.select("event_id", "series", fixed(c("position"), 4).alias("position"))


# Sessions: orders of a customer, newest by order date.


def stored(t):
    return t.orders.select(
        c("o_orderkey").alias("id"), c("o_custkey").alias("owner"),
        epoch_micros(c("o_orderdate")).alias("created"),
        F.when(c("o_orderstatus") != "P", F.floor("o_totalprice")).alias("size"),
    )


STORED_SQL = """stored as (select o_orderkey as id, o_custkey as owner,
        epoch_us(o_orderdate) as created,
        case when o_orderstatus <> 'P' then cast(floor(o_totalprice) as bigint) end as size from orders)"""


@query(
    "recent_sessions",
    f"with {STORED_SQL} select id, owner, created from stored order by created desc, id limit 5",
)
def _(t):
    return Z.recent_sessions(stored(t), "created", "id").select("id", "owner", "created")


@query(
    "keep_newest",
    f"""with {STORED_SQL}, n as (select *, row_number() over (partition by owner
        order by created desc, id) as n from stored) select id, owner, created, size from n where n <= 5""",
)
def _(t):
    return Z.keep_newest(stored(t), "owner", "created", "id")


@query(
    "prune_ids",
    f"""with {STORED_SQL}, n as (select *, row_number() over (partition by owner
        order by created desc, id) as n from stored) select owner, id from n where n > 5""",
)
def _(t):
    return Z.prune_ids(stored(t), "owner", "id", "created", "id")


@query("lookup_session", f"with {STORED_SQL} select * from stored where id = 42")
def _(t):
    return Z.lookup_session(stored(t), "id", 42)


@query(
    "read_sessions",
    f"""with {STORED_SQL} select id, owner, case when id % 4 = 0 then -1 else size end as size
    from stored""",
)
def _(t):
    rows = stored(t).select("id", "owner", "size")
    live = rows.where("id % 4 = 0").withColumn("size", F.lit(-1).cast("bigint"))
    return Z.lookup_sessions(live, rows, "id")


@query(
    "upsert_sessions",
    f"""with {STORED_SQL},
    puts as (select id - id % 3 as id, owner, created + id * 1000 as created, size from stored
        where id % 2 = 0),
    latest as (select * from (select *, row_number() over (partition by id
        order by created desc, owner desc, size desc) as n from puts) where n = 1),
    merged as (select * from stored where id not in (select id from latest)
        union all select id, owner, created, size from latest),
    kept as (select *, row_number() over (partition by owner order by created desc, id) as k
        from merged)
    select id, owner, created from kept where k <= 3""",
)
def _(t):
    rows = stored(t)
    puts = rows.where("id % 2 = 0").select(
        (c("id") - c("id") % 3).alias("id"), "owner",
        (c("created") + c("id") * 1000).alias("created"), "size",
    )
    out = Z.upsert_sessions(rows, puts, "id", "owner", "created", "id", keep=3)
    return out.select("id", "owner", "created")


@query("delete_sessions", f"with {STORED_SQL} select id, owner from stored where id % 5 <> 1")
def _(t):
    rows = stored(t)
    return Z.delete_sessions(rows, rows.where("id % 5 = 1"), "id").select("id", "owner")


@query(
    "latest_only",
    f"""with {STORED_SQL} select owner, id, created, size from (select *, row_number() over
        (partition by owner order by created desc, id desc) as n from stored) where n = 1""",
)
def _(t):
    rows = stored(t).select("owner", "id", "created", "size")
    return Z.latest_only(rows, "owner", "created", "id")


@query(
    "storage_report",
    f"""with {STORED_SQL} select count(*) as session_count,
        cast(coalesce(sum(coalesce(size, 0)), 0) as bigint) as session_bytes,
        cast(null as bigint) as origin_bytes,
        (select count(*) > 0 from region) as has_keys from stored""",
)
def _(t):
    return Z.storage_report(stored(t), "size", t.region)


@query(
    "name_fallback",
    """select o_orderkey, case when o_custkey % 3 = 0 then c_name
        when o_custkey % 3 = 1 then 'seen ' || o_custkey end as name
    from orders left join customer on o_custkey = c_custkey""",
)
def _(t):
    ids = t.orders.select("o_orderkey", c("o_custkey").alias("c_custkey"))
    live = t.customer.where("c_custkey % 3 = 0").select("c_custkey", c("c_name").alias("name"))
    seen = F.concat(F.lit("seen "), c("c_custkey").cast("string"))
    crumbs = t.customer.where("c_custkey % 3 <> 2").select("c_custkey", seen.alias("name"))
    return Z.name_fallback(ids, live, crumbs, "c_custkey").select("o_orderkey", "name")


# Selections: the refs (order mod 500, line number) of returned lines.

SELECT_SQL = """sel as (select distinct l_orderkey % 500 as pair, l_linenumber + 10 * (l_partkey % 5)
            as idx from lineitem where l_returnflag = 'R'),
    other as (select distinct l_orderkey % 500 as pair, l_linenumber + 10 * (l_partkey % 5) as idx
        from lineitem where l_returnflag = 'A' and l_linestatus = 'F')"""


def refs(t, condition):
    return t.lineitem.where(condition).select(
        (c("l_orderkey") % 500).alias("pair"),
        (c("l_linenumber") + 10 * (c("l_partkey") % 5)).alias("idx"),
    ).distinct()


def selected(t):
    return refs(t, "l_returnflag = 'R'")


def others(t):
    return refs(t, "l_returnflag = 'A' and l_linestatus = 'F'")


@query(
    "toggle_refs",
    f"""with {SELECT_SQL} (select * from sel except select * from other)
    union all (select * from other except select * from sel)""",
)
def _(t):
    return S.toggle_refs(selected(t), others(t))


@query("remove_group", f"with {SELECT_SQL} select * from sel where pair % 7 <> 3")
def _(t):
    rows = selected(t)
    return S.remove_groups(rows, rows.where("pair % 7 = 3").select("pair").distinct())


@query(
    "prune_selection",
    f"""with {SELECT_SQL} select s.pair, s.idx - (select count(*) from other o
            where o.pair = s.pair and o.idx < s.idx) as idx
    from sel s where not exists (select 1 from other o where o.pair = s.pair and o.idx = s.idx)""",
)
def _(t):
    return S.prune_selection(selected(t), others(t))


@query(
    "in_range",
    f"""with {SELECT_SQL} select pair, idx from sel
    where case when pair % 4 = 0 then idx = 12 else idx between 12 and 31 end""",
)
def _(t):
    rows = selected(t)
    pair = c("pair")
    ranges = rows.select("pair").distinct().select(
        "pair", F.lit(31).alias("idx_a"), F.lit(12).alias("idx_b"),
        F.when(pair % 4 == 0, pair + 1).otherwise(pair).alias("anchor_pair"),
    )
    return S.in_range(rows, ranges)


@query(
    "selected_indices",
    f"""with {SELECT_SQL} select pair, row_number() over (partition by pair order by idx) - 1 as position, idx
    from (select distinct pair, idx from sel)""",
)
def _(t):
    return S.selected_indices(selected(t))


@query(
    "selection_summary",
    f"""with {SELECT_SQL} select pair % 10 as sel_id, count(*) as refs, count(distinct pair) as pairs
    from sel group by pair % 10""",
)
def _(t):
    rows = selected(t).withColumn("sel_id", c("pair") % 10)
    out = S.selection_summary(rows, "sel_id")
    return out


@query(
    "set_fingerprint",
    f"""with {SELECT_SQL}, r as (select distinct pair % 100 as sel_id, md5(pair || '.' || idx) as h from sel)
    select sel_id, 'drag-' || count(*) || '-' || sum(('0x' || h[1:15])::bigint) || '-' ||
        sum(('0x' || h[16:30])::bigint) as fingerprint from r group by sel_id""",
)
def _(t):
    rows = selected(t).withColumn("sel_id", c("pair") % 100)
    return S.set_fingerprint(rows, "sel_id", "drag-")


@query(
    "membership",
    f"""with {SELECT_SQL}, one as (select * from sel where pair % 2 = 0)
    select o.pair, o.idx, exists (select 1 from one s where s.pair = o.pair and s.idx = o.idx)
            as is_selected,
        exists (select 1 from one s where s.pair = o.pair) as pair_selected
    from other o""",
)
def _(t):
    return S.membership(others(t), selected(t).where("pair % 2 = 0"))


@query(
    "single_selected",
    f"""with {SELECT_SQL} select pair * 7 + idx % 7 as sel_id, min(idx) as idx from sel
    group by pair, idx % 7 having count(*) = 1""",
)
def _(t):
    rows = selected(t).withColumn("sel_id", c("pair") * 7 + c("idx") % 7)
    return S.single_selected(rows, "sel_id").select("sel_id", "idx")
