"""Row-wise expressions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelane.functions import scalars as S
from timelane.functions import text as X
from timelane.plans.registry import query
from timelane.session import epoch_micros, widen

c = F.col

# Codec id of a part: p_size modulo 9 reaches all known ids and some unknown ones.
CODEC_SQL = (
    "case p_size % 9 when 0 then 'pcm' when 4 then 'adpcm' when 7 then 'mp3' else 'unknown' end"
)


@query("codec_name", f"select p_partkey, {CODEC_SQL} as codec from part")
def _(t):
    return t.part.select("p_partkey", S.codec_name(c("p_size") % 9).alias("codec"))


@query(
    "unpack_bits",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber,
        (l_orderkey & 1) <> 0 as chunk_indices,
        (l_orderkey & 2) <> 0 as single_channel_encrypt,
        (l_orderkey & 4) <> 0 as multi_channel,
        (l_orderkey & 8) <> 0 as multi_channel_encrypt
    from lineitem""",
)
def _(t):
    flags = S.flag_bits(c("l_orderkey"))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        *[f.alias(n) for n, f in flags.items()],
    )


@query(
    "hash_hex",
    "select o_orderkey, '0x' || lpad(lower(printf('%x', o_orderkey * 7919)), 8, '0') as hash_hex from orders",
)
def _(t):
    return t.orders.select("o_orderkey", S.hash_hex(c("o_orderkey") * 7919).alias("hash_hex"))


@query(
    "duration_seconds",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber,
        case when l_linenumber % 3 > 0 then l_quantity / (l_linenumber % 3) else 0.0 end
            as duration_seconds
    from lineitem""",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        S.duration_seconds(c("l_quantity"), c("l_linenumber") % 3).alias("duration_seconds"),
    )


@query(
    "clamp",
    """select event_id, greatest(0.0::double, least(1.5::double, value / 100)) as gain,
        greatest(20.0::double, value) as at_least, least(20.0::double, value) as at_most
    from events""",
)
def _(t):
    v = c("value")
    return t.events.select(
        "event_id", S.clamp(v / 100, 0.0, 1.5).alias("gain"),
        S.clamp(v, low=20.0).alias("at_least"), S.clamp(v, high=20.0).alias("at_most"),
    )


@query(
    "pan_spread",
    """select c_custkey,
        abs(c_acctbal / 10000) as spread,
        case when c_custkey % 2 = 0
            then -greatest(0.0::double, least(1.0::double, abs(c_acctbal / 5000)))
            else greatest(0.0::double, least(1.0::double, abs(c_acctbal / 5000))) end as pan
    from customer""",
)
def _(t):
    side = F.when(c("c_custkey") % 2 == 0, "L").otherwise("R")
    return t.customer.select(
        "c_custkey", S.pan_spread(c("c_acctbal") / 10000).alias("spread"),
        S.side_pan(F.abs(c("c_acctbal") / 5000), side).alias("pan"),
    )


@query(
    "equal_power_pan",
    """select vec_id,
        floor(cos((pan + 1.0) / 2.0 * (pi() / 2.0)) * 1e6 + 0.5) / 1e6 as left_gain,
        floor(sin((pan + 1.0) / 2.0 * (pi() / 2.0)) * 1e6 + 0.5) / 1e6 as right_gain
    from (select vec_id, ((vec_id * 37) % 201 - 100) / 100.0::double as pan from embeddings)""",
)
def _(t):
    pan = ((c("vec_id") * 37) % 201 - 100) / F.lit(100.0)
    left, right = S.equal_power_pan(pan)
    return t.embeddings.select(
        "vec_id", S.fixed(left).alias("left_gain"), S.fixed(right).alias("right_gain")
    )


@query(
    "gain_db",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber,
        case when g <= 0.0001 then '-∞'
             when 20 * log10(g) >= 0 then '+' || printf('%.1f', 20 * log10(g))
             else printf('%.1f', 20 * log10(g)) end as gain_db
    from (select *, l_discount * 15 as g from lineitem)""",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        X.gain_db(c("l_discount") * 15).alias("gain_db"),
    )


@query(
    "gain_percent",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber,
        cast(cast(floor(l_tax * 17.3 * 100 + 0.5) as bigint) as varchar) || '%' as gain_percent
    from lineitem""",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        X.gain_percent(c("l_tax") * 17.3).alias("gain_percent"),
    )


@query(
    "format_bytes",
    """select doc_id,
        case when b < 1024 then b || ' B'
             when b < 1048576 then printf('%.1f KiB', b::double / 1024)
             when b < 1073741824 then printf('%.1f MiB', b::double / 1048576)
             else printf('%.2f GiB', b::double / 1073741824) end as size_text,
        printf('%.1f MB', b::double / 1048576) as megabytes
    from (select doc_id, n_chars * (1 + doc_id * 733) as b from documents)""",
)
def _(t):
    b = c("n_chars") * (1 + c("doc_id") * 733)
    return t.documents.select(
        "doc_id", X.format_bytes(b).alias("size_text"), X.format_megabytes(b).alias("megabytes")
    )


@query(
    "format_duration",
    """with e as (select event_id, (value - 100) * 3.1 as s from events),
    f as (select event_id, s, cast(floor(s + 0.5) as bigint) as whole,
        case when s < 0 then 0.0::double else s end as z from e)
    select event_id,
        case when s > 0 then (whole // 60) || ':' || lpad(cast(whole % 60 as varchar), 2, '0')
             else '-' end as listing,
        case when s >= 0 then cast(floor(s / 60) as bigint) || ':'
                || lpad(cast(cast(floor(s % 60) as bigint) as varchar), 2, '0')
             else '-' end as short,
        cast(floor(z / 60) as bigint) || ':'
            || lpad(cast(cast(floor(z % 60) as bigint) as varchar), 2, '0') as readout,
        cast(floor(z / 60) as bigint) || ':' || lpad(cast(h // 100 as varchar), 2, '0') || '.'
            || lpad(cast(h % 100 as varchar), 2, '0') as precise
    from (select *, cast(round(printf('%.20f', z % 60)::decimal(30, 20), 2) * 100 as bigint) as h from f)""",
)
def _(t):
    s = (c("value") - 100) * 3.1
    return t.events.select(
        "event_id",
        *[X.format_duration(s, m).alias(m) for m in ("listing", "short", "readout", "precise")],
    )


@query(
    "format_age",
    """with a as (select o_orderkey,
        (epoch_us(timestamp '2001-08-01 00:00:00') - epoch_us(o_orderdate)) // 1000
            // (1 + o_orderkey * o_orderkey) as ms from orders),
    b as (select o_orderkey, ms, ms // 60000 as m from a)
    select o_orderkey,
        case when ms < 0 or m < 1 then 'just now'
             when m < 60 then m || 'm ago'
             when m // 60 < 24 then (m // 60) || 'h ago'
             else (m // 60 // 24) || 'd ago' end as age
    from b""",
)
def _(t):
    now = epoch_micros(F.lit("2001-08-01 00:00:00").cast("timestamp_ntz"))
    ms = now - epoch_micros(c("o_orderdate"))
    spread = F.floor(F.floor(ms / 1000) / (1 + c("o_orderkey") * c("o_orderkey")))
    return t.orders.select("o_orderkey", X.format_age(spread).alias("age"))


@query(
    "safe_name",
    r"""select p_partkey,
        regexp_replace(regexp_replace('  ' || p_name || ' #' || p_brand || '!',
            '[^a-z0-9._+-]+', '_', 'gi'), '^_+|_+$', '', 'g') as safe_name
    from part""",
)
def _(t):
    raw = F.concat(F.lit("  "), c("p_name"), F.lit(" #"), c("p_brand"), F.lit("!"))
    return t.part.select("p_partkey", X.safe_name(raw).alias("safe_name"))


@query(
    "strip_extension",
    r"""select page_id,
        regexp_replace(url, '\?PAGE=2$', '', 'i') as stripped,
        case when regexp_replace('x' || page_id || '.AWC', '\.awc$', '', 'i') = '' then 'mix'
             else regexp_replace('x' || page_id || '.AWC', '\.awc$', '', 'i') end as base
    from pages""",
)
def _(t):
    named = F.concat(F.lit("x"), c("page_id").cast("string"), F.lit(".AWC"))
    return t.pages.select(
        "page_id", X.strip_extension(c("url"), "?PAGE=2").alias("stripped"),
        X.strip_extension(named, ".awc", "mix").alias("base"),
    )


@query(
    "path_parts",
    r"""select page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) as parent,
        lower(split_part(url, '/', -1)) as name
    from pages""",
)
def _(t):
    return t.pages.select(
        "page_id", X.path_parent(c("url")).alias("parent"),
        F.lower(X.path_name(c("url"))).alias("name"),
    )


@query(
    "classify_file",
    """select page_id,
        case when lower(url) like '%5' then 'container' when lower(url) like '%#top' then 'archive' end
            as kind
    from pages""",
)
def _(t):
    return t.pages.select(
        "page_id",
        X.classify_file(F.upper(c("url")), {"5": "container", "#top": "archive"}).alias("kind"),
    )


@query(
    "jenkins29",
    """with bytes as (select p_partkey,
        list_transform(range(1, length(lower(p_name || '_' || p_partkey)) + 1),
            lambda i: ascii(substring(lower(p_name || '_' || p_partkey), i, 1))::bigint) as b
        from part),
    mixed as (select p_partkey, list_reduce(list_prepend(0::bigint, b), lambda h, x:
        xor(((h + x) & 4294967295) + ((((h + x) & 4294967295) << 10) & 4294967295) & 4294967295,
            ((((h + x) & 4294967295) + ((((h + x) & 4294967295) << 10) & 4294967295))
                & 4294967295) >> 6)) as h from bytes),
    f1 as (select p_partkey, (h + (h << 3)) & 4294967295 as h from mixed),
    f2 as (select p_partkey, xor(h, h >> 11) as h from f1)
    select p_partkey, (h + (h << 15)) & 4294967295 & 536870911 as hash from f2""",
)
def _(t):
    name = F.concat(c("p_name"), F.lit("_"), c("p_partkey").cast("string"))
    return widen(t.part).select("p_partkey", S.jenkins29(name).alias("hash"))


# A header word per order line: sync bits set, the other bits from the keys.
WORD_SQL = "(4292870144 | ((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber) & 2097151))"


def header_word():
    mixed = c("l_orderkey") * 7919 + c("l_partkey") * 104729 + c("l_linenumber")
    return F.lit(0xFFE00000).cast("bigint").bitwiseOR(mixed.bitwiseAND(F.lit(0x1FFFFF).cast("bigint")))


def _bitrates_sql():
    rows = [
        f"({family},{layer},{i},{v * 1000})"
        for (family, layer), values in S.BITRATES.items()
        for i, v in enumerate(values)
    ]
    return "(values " + ",".join(rows) + ") as b(family, lay, idx, rate)"


FRAME_SQL = f"""with w as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
        l_extendedprice, {WORD_SQL} as word from lineitem),
    f as (select *, (word >> 19) & 3 as v, (word >> 17) & 3 as l, (word >> 12) & 15 as r,
        (word >> 10) & 3 as s, (word >> 9) & 1 as pad, (word >> 6) & 3 as mode,
        (word >> 4) & 15 as nib, (word & 65536) = 0 as crc from w),
    g as (select *, v <> 1 and l <> 0 and r <> 15 and s <> 3
            and nib in (0, 4, 5, 6, 7, 8, 12) as valid,
        case v when 0 then 25 when 2 then 20 when 3 then 10 else 0 end as version,
        (4 - l) % 4 as layer from f),
    h as (select g.*, b.rate,
        case s when 0 then 44100 when 1 then 48000 when 2 then 32000 end
            // (case version when 25 then 4 when 20 then 2 else 1 end) as hz
        from g left join {_bitrates_sql()}
            on b.family = (case when version = 10 then 1 else 2 end) and b.lay = layer and b.idx = r),
    fields as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
        valid,
        case when valid then version end::bigint as version,
        case when valid then layer end::bigint as layer,
        case when valid then crc end as has_crc,
        case when valid then rate end::bigint as bit_rate,
        case when valid then hz end::bigint as sample_rate,
        case when valid then pad end::bigint as padding,
        case when valid then mode end::bigint as channel_mode,
        case when valid then case when mode = 3 then 1 else 2 end end::bigint as channels,
        case when valid then case when layer = 1 then 384
            when layer = 3 and version > 10 then 576 else 1152 end end::bigint as sample_count,
        case when valid and r > 0 then case when layer = 1
                then cast(floor(((12 * rate) / hz::double + pad) * 4) as bigint)
                else cast(floor((144 * rate) / hz::double) as bigint) + pad end
            end::bigint as frame_size
    from h)"""


def frame_fields(t):
    fields = S.frame_header_fields(header_word())
    return widen(t.lineitem).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        *[f.alias(n) for n, f in fields.items()],
    )


@query("frame_header_fields", FRAME_SQL + " select * from fields")
def _(t):
    return frame_fields(t)


@query(
    "frame_filter",
    FRAME_SQL + " select * exclude (valid) from fields where valid and version = 10 and layer = 3",
)
def _(t):
    return frame_fields(t).where("valid and version = 10 and layer = 3").drop("valid")


@query(
    "entry_size",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber,
        case kind when 'directory' then 0
            when 'binary' then case when unpacked > 0 or file_size = 0 then unpacked else file_size end
            else file_size end::bigint as size,
        kind <> 'directory' and file_size > 0 as is_compressed,
        (kind = 'binary' and l_suppkey % 2 = 1)
            or (kind = 'resource' and l_partkey % 5 = 0) as is_encrypted
    from (select *, case l_linenumber % 3 when 0 then 'directory' when 1 then 'binary'
            else 'resource' end as kind,
        l_partkey % 4 as file_size, l_suppkey % 3 as unpacked from lineitem)""",
)
def _(t):
    kind = (
        F.when(c("l_linenumber") % 3 == 0, S.DIRECTORY)
        .when(c("l_linenumber") % 3 == 1, S.BINARY)
        .otherwise(S.RESOURCE)
    )
    file_size, unpacked = c("l_partkey") % 4, c("l_suppkey") % 3
    name = F.when(c("l_partkey") % 5 == 0, "A.YSC").otherwise("a.bin")
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        S.entry_size(kind, file_size, unpacked).cast("bigint").alias("size"),
        S.entry_compressed(kind, file_size).alias("is_compressed"),
        S.entry_encrypted(kind, c("l_suppkey") % 2, name).alias("is_encrypted"),
    )


@query(
    "quantize_pcm16",
    """select vec_id, i - 1 as frame,
        case when s < 0 then cast(trunc(s * 32768) as integer)
             else cast(trunc(s * 32767) as integer) end as pcm
    from (select vec_id, i,
            greatest(-1.0::double, least(1.0::double, embedding[i]::double * 4)) as s
        from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))""",
)
def _(t):
    rows = t.embeddings.select("vec_id", F.posexplode("embedding").alias("frame", "v"))
    return rows.select(
        "vec_id", c("frame").cast("bigint").alias("frame"),
        S.quantize_pcm16(c("v").cast("double") * 4).alias("pcm"),
    )


@query(
    "loop_bounds",
    """with x as (select l_orderkey, l_partkey, l_suppkey, l_linenumber,
            l_quantity as a, l_discount * 500 - 5 as b, 40.0::double as d from lineitem),
    y as (select *, greatest(0.0::double, least(d, least(a, b))) as lo,
        greatest(0.0::double, least(d, greatest(a, b))) as hi from x)
    select l_orderkey, l_partkey, l_suppkey, l_linenumber,
        case when hi - lo >= 0.05 then lo end as loop_start,
        case when hi - lo >= 0.05 then hi end as loop_end,
        case when hi - lo >= 0.05 then lo else d * 0.25 end as toggled_start,
        case when hi - lo >= 0.05 then hi else d * 0.75 end as toggled_end
    from y""",
)
def _(t):
    d = F.lit(40.0)
    start, end = S.loop_bounds(c("l_quantity"), c("l_discount") * 500 - 5, d)
    begin, finish = S.default_loop(c("loop_start"), c("loop_end"), d)
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        start.alias("loop_start"), end.alias("loop_end"),
    ).select("*", begin.alias("toggled_start"), finish.alias("toggled_end"))


@query(
    "loop_wrap",
    """select event_id, floor((case when p < 12.5 then p
            else 5.0 + ((p - 5.0) - 7.5 * floor((p - 5.0) / 7.5)) end) * 1e6 + 0.5) / 1e6 as position
    from (select event_id, value as p from events)""",
)
def _(t):
    wrapped = S.loop_wrap(c("value"), F.lit(5.0), F.lit(12.5))
    return t.events.select("event_id", S.fixed(wrapped).alias("position"))


@query(
    "parse_number",
    r"""select event_id, try_cast(nullif(regexp_extract(trim(x),
            '^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1), '') as double) as number
    from (select event_id, case event_id % 4 when 0 then '  ' || value || ' db'
        when 1 then props when 2 then '-' || replace(replace(props, '{"k": ', ''), '}', '.5s')
        else '' end as x from events)""",
)
def _(t):
    k = F.regexp_extract("props", r"(\d+)", 1)
    raw = (
        F.when(c("event_id") % 4 == 0, F.concat(F.lit("  "), c("value").cast("string"), F.lit(" db")))
        .when(c("event_id") % 4 == 1, c("props"))
        .when(c("event_id") % 4 == 2, F.concat(F.lit("-"), k, F.lit(".5s")))
        .otherwise(F.lit(""))
    )
    return t.events.select("event_id", X.parse_number(raw).alias("number"))


@query(
    "pair_key_parse",
    r"""select c_custkey, cast(regexp_extract(k, '^pair-(\d+)$', 1) as bigint) as pair
    from (select c_custkey, case when c_custkey % 3 = 0 then c_name else 'pair-' || c_custkey end as k
        from customer) where regexp_matches(k, '^pair-\d+$')""",
)
def _(t):
    key = F.when(c("c_custkey") % 3 == 0, c("c_name")).otherwise(
        F.concat(F.lit("pair-"), c("c_custkey").cast("string"))
    )
    return t.customer.select("c_custkey", X.pair_key_index(key).alias("pair")).where("pair is not null")
