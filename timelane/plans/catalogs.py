"""Catalogue queries: containers and archives whose bytes Spark builds from the tables,
and the record operators on lineitem, orders, part and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelane.functions import scalars as S
from timelane.functions.bits import big_hex, little_hex
from timelane.operators import catalog as A
from timelane.operators import quality as Q
from timelane.operators import sessions as Z
from timelane.operators import trees as T
from timelane.operators.mix import positions
from timelane.operators.ordered import collect_parts
from timelane.plans.inputs import PLACED_SQL, members
from timelane.plans.registry import query
from timelane.session import ensure_checkpoint_dir, widen
from timelane.sources import containers as C

c = F.col

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
LINE_KEY = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
STREAMS_PER_FILE = 6

# One container per order and six lines: a line is a stream with a format chunk and, two
# times of three, a data chunk. Odd orders are big-endian.
FILES_SQL = f"""numbered as (select *, row_number() over (partition by l_orderkey order by {LINE_KEY}) - 1
        as n from lineitem),
    streams as (select l_orderkey as ok, n // {STREAMS_PER_FILE} as part, n % {STREAMS_PER_FILE} as ordinal,
        l_partkey * 131071 % 536870912 as id, case when l_linenumber % 3 = 0 then 1 else 2 end as chunk_count,
        cast(l_quantity * 1000 as bigint) as samples, case when l_suppkey % 4 = 0 then 0 else 48000 end as rate,
        l_partkey % 9 as codec_id, 20 * (n % {STREAMS_PER_FILE} + 1) as data_size from numbered),
    files as (select ok, part, count(*) as stream_count, ok % 16 & 11 as flags,
        16 + case when ok % 2 = 1 then 2 * count(*) else 0 end + 4 * count(*)
            + 8 * sum(chunk_count) as body, ok % 13 <> 5 as good from streams group by ok, part)"""


def put(value, size):
    """Hex of an unsigned number in the file's byte order."""
    return F.when(c("little"), little_hex(value, size)).otherwise(big_hex(value, size))


def record(kind, size, at):
    """Hex of a chunk record: type:8 size:28 offset:28, all sizes here below 16 MiB."""
    place = F.shiftleft(size.cast("bigint"), 28) + at.cast("bigint")
    return put(F.lit(kind - 256 if kind > 127 else kind).cast("bigint") * (1 << 56) + place, 8)


def container_files(t):
    """Bytes of the derived containers, keyed by order and part."""
    line = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    parts = collect_parts(t.lineitem, "l_orderkey", LINE_ORDER, line, "lines", STREAMS_PER_FILE)
    rows = parts.withColumn("little", c("l_orderkey") % 2 == 0).withColumn(
        "flags", (c("l_orderkey") % 16).bitwiseAND(F.lit(11).cast("bigint"))
    )
    n = F.size("lines")

    def chunks_of(x):
        return F.when(x["l_linenumber"] % 3 == 0, 1).otherwise(2)

    def joined(fn):
        return F.array_join(F.transform("lines", fn), "")

    total = F.aggregate("lines", F.lit(0), lambda a, x: a + chunks_of(x))
    skipped = F.when(c("flags") % 2 == 1, n * 2).otherwise(0)
    rows = rows.withColumn("body", 16 + skipped + 4 * n + 8 * total)

    def records(x, i):
        at = (c("body") + i * 20).cast("bigint")
        fmt = record(C.CHUNK_FORMAT, F.lit(20).cast("bigint"), at)
        data = record(C.CHUNK_DATA, (20 * (i + 1)).cast("bigint"), c("body").cast("bigint"))
        return F.when(chunks_of(x) == 1, fmt).otherwise(F.concat(fmt, data))

    def stream(x):
        word = F.shiftleft(chunks_of(x).cast("bigint"), 29) + x["l_partkey"] * 131071 % 536870912
        return put(word, 4)

    def payload(x):
        rate = F.when(x["l_suppkey"] % 4 == 0, 0).otherwise(48000)
        return F.concat(
            put((x["l_quantity"] * 1000).cast("bigint"), 4), F.lit("FFFFFFFF"), put(rate, 2),
            F.lit("0000" * 4 + "00"), big_hex(x["l_partkey"] % 9, 1),
        )

    version = F.when(c("l_orderkey") % 13 == 5, 3).otherwise(1)
    text = F.concat(
        F.when(c("little"), F.lit("41444154")).otherwise(F.lit("54414441")), put(version, 2),
        put(c("flags"), 2), put(n, 4), put(c("body"), 4), F.repeat(F.lit("00"), skipped),
        joined(stream), F.array_join(F.transform("lines", records), ""), joined(payload),
    )
    # The bytes stand in for stored files, so they are made once.
    ensure_checkpoint_dir(t.spark)
    return rows.select(c("l_orderkey").alias("ok"), "part", F.unhex(text).alias("content")).checkpoint()


KEYS = ("ok", "part")


def container_index(t):
    return C.container_index(container_files(t))


@query(
    "container_header",
    f"""with {FILES_SQL} select ok, part, case when not good then 'version' end as reason,
        case when not good then 4 end::bigint as "offset",
        case when good then case when ok % 2 = 0 then 'LE' else 'BE' end end as endianness,
        case when good then stream_count end as stream_count,
        case when good then flags end as flags, case when good then body end::bigint as data_offset,
        case when good then (flags & 1) <> 0 end as chunk_indices,
        case when good then (flags & 8) <> 0 end as multi_channel_encrypt from files""",
)
def _(t):
    return C.container_header(C.container_index(container_files(t)), KEYS).select(
        "ok", "part", "reason", "offset", "endianness", "stream_count", "flags", "data_offset",
        "chunk_indices", "multi_channel_encrypt",
    )


@query(
    "container_streams",
    f"""with {FILES_SQL} select s.ok, s.part, s.ordinal, s.id, s.chunk_count::bigint as chunk_count
    from streams s join files f on s.ok = f.ok and s.part = f.part where good""",
)
def _(t):
    return C.container_streams(C.container_index(container_files(t)), KEYS)


@query(
    "container_chunks",
    f"""with {FILES_SQL}, placed as (select s.*, f.body, coalesce(sum(chunk_count) over (
            partition by s.ok, s.part order by ordinal rows between unbounded preceding and 1 preceding), 0)
            as first from streams s join files f on s.ok = f.ok and s.part = f.part where good)
    select ok, part, ordinal, id, first::bigint as chunk, 250::bigint as type, 20::bigint as size,
        (body + ordinal * 20)::bigint as "offset" from placed
    union all select ok, part, ordinal, id, (first + 1)::bigint, 85, data_size, body::bigint
        from placed where chunk_count = 2""",
)
def _(t):
    return C.container_chunks(container_index(t), KEYS).select(
        "ok", "part", "ordinal", "id", "chunk", "type", "size", "offset"
    )


@query(
    "container_formats",
    f"""with {FILES_SQL} select s.ok, s.part, s.id, last(samples order by ordinal) as samples,
        last(rate order by ordinal)::bigint as sample_rate, -1::bigint as loop_point,
        last(codec_id order by ordinal) as codec_id
    from streams s join files f on s.ok = f.ok and s.part = f.part where good group by s.ok, s.part, s.id""",
)
def _(t):
    chunks = C.container_chunks(container_index(t), KEYS)
    return C.container_formats(chunks, KEYS).select(
        "ok", "part", "id", "samples", "sample_rate", "loop_point", "codec_id"
    )


@query(
    "playable_streams",
    f"""with {FILES_SQL}, ids as (select s.ok, s.part, s.id, last(samples order by ordinal) as samples,
        last(rate order by ordinal) as rate, last(codec_id order by ordinal) as codec_id,
        last(data_size order by ordinal) filter (where chunk_count = 2) as data_size
        from streams s group by s.ok, s.part, s.id)
    select s.ok, s.part, s.ordinal as idx, s.id as hash,
        '0x' || lpad(lower(printf('%x', s.id)), 8, '0') as hash_hex,
        case i.codec_id when 0 then 'pcm' when 4 then 'adpcm' when 7 then 'mp3' else 'unknown' end as codec,
        i.samples as sample_count,
        case when i.rate > 0 then i.samples / i.rate::double else 0.0 end as duration_seconds,
        (f.flags & 2) <> 0 as encrypted, i.data_size
    from streams s join files f on s.ok = f.ok and s.part = f.part
        join ids i on i.ok = s.ok and i.part = s.part and i.id = s.id
    where good and i.data_size is not null""",
)
def _(t):
    return C.playable_streams(container_index(t), KEYS).select(
        "ok", "part", "idx", "hash", "hash_hex", "codec", "sample_count", "duration_seconds",
        "encrypted", "data_size",
    )


# The same lines as channels of multi-channel containers: one stream, a stream format, and two blocks, of
# which the second is cut short behind its headers.

SPARE = 16
MULTI_SQL = f"""{FILES_SQL}, lines as (select l_orderkey as ok, n // {STREAMS_PER_FILE} as part,
        n % {STREAMS_PER_FILE} as channel, l_partkey, l_suppkey, l_linenumber, l_quantity from numbered),
    multi as (select ok, part, count(*) as channels, 24 * count(*) + {SPARE} as block_size,
        48 + 16 * count(*) as data_offset from lines group by ok, part)"""


def multi_files(t):
    line = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    rows = collect_parts(t.lineitem, "l_orderkey", LINE_ORDER, line, "lines", STREAMS_PER_FILE).withColumn(
        "little", c("l_orderkey") % 2 == 0)
    n = F.size("lines").cast("bigint")
    block, formats = n * 24 + SPARE, n * 16 + 12

    def channel(x):
        return F.concat(
            put(x["l_partkey"] * 131071 % 536870912, 4), put((x["l_quantity"] * 100).cast("bigint"), 4),
            put(x["l_suppkey"] % 100, 2), put(F.lit(32000), 2), big_hex(x["l_partkey"] % 9, 1), F.lit("00" * 3))

    def headers(at):
        return F.array_join(F.transform("lines", lambda x: F.concat(
            F.lit("00" * 4), little_hex(x["l_linenumber"] + at, 4), little_hex(x["l_suppkey"] % 3, 4),
            little_hex((x["l_quantity"] * 10).cast("bigint") + at, 4), F.lit("00" * 4),
            little_hex(x["l_partkey"] % 50, 4))), "")

    flags = F.when(c("l_orderkey") % 3 == 0, 12).otherwise(4)
    text = F.concat(
        F.when(c("little"), F.lit("41444154")).otherwise(F.lit("54414441")), put(F.lit(1), 2), put(flags, 2),
        put(F.lit(1), 4), put(formats + 36, 4), put(F.lit((2 << 29) + 77), 4),
        record(C.CHUNK_STREAM_FORMAT, formats, F.lit(36).cast("bigint")),
        record(C.CHUNK_DATA, block + n * 24, formats + 36),
        put(F.lit(2), 4), put(block, 4), put(n, 4), F.array_join(F.transform("lines", channel), ""),
        headers(F.lit(0)), F.lit("00" * SPARE), headers(F.lit(1)),
    )
    ensure_checkpoint_dir(t.spark)
    return rows.select(c("l_orderkey").alias("ok"), "part", F.unhex(text).alias("content")).checkpoint()


@query(
    "stream_format",
    f"""with {MULTI_SQL} select ok, part, channel, 2::bigint as block_count, block_size, channels as channel_count,
        l_partkey * 131071 % 536870912 as id, cast(l_quantity * 100 as bigint) as samples,
        l_suppkey % 100 as headroom, 32000 as sample_rate, l_partkey % 9 as codec_id
    from lines join multi using (ok, part)""",
)
def _(t):
    chunks = C.container_chunks(C.container_index(multi_files(t)), KEYS)
    found = C.stream_format(chunks, KEYS).select(
        *KEYS, "block_count", "block_size", "channel_count", F.posexplode("channels").alias("channel", "ch"))
    numbers = ("channel", "block_count", "block_size", "channel_count", "id", "samples", "headroom", "codec_id")
    return found.select(*found.columns[:-1], "ch.*").select(
        *KEYS, *[c(x).cast("bigint").alias(x) for x in numbers], c("sample_rate").cast("int").alias("sample_rate"))


@query(
    "multi_channel_streams",
    f"""with {MULTI_SQL} select ok, part, channel as idx, l_partkey * 131071 % 536870912 as hash,
        case l_partkey % 9 when 0 then 'pcm' when 4 then 'adpcm' when 7 then 'mp3' else 'unknown' end as codec,
        cast(l_quantity * 100 as bigint) as sample_count, cast(l_quantity * 100 as bigint) / 32000::double
            as duration_seconds, 'mc-channel' as layout, ok % 3 = 0 as encrypted, data_offset,
        block_size + 24 * channels as data_size, 2::bigint as block_count
    from lines join multi using (ok, part)""",
)
def _(t):
    return C.playable_streams(C.container_index(multi_files(t)), KEYS).select(
        "ok", "part", "idx", "hash", "codec", "sample_count", "duration_seconds", "layout", "encrypted",
        "data_offset", "data_size", "block_count")


@query(
    "block_headers",
    f"""with {MULTI_SQL} select ok, part, block, channel, data_offset + block * block_size as block_start,
        case block when 0 then block_size else 24 * channels end as block_length,
        l_linenumber + block as sub_blocks, l_suppkey % 3 as discard,
        cast(l_quantity * 10 as bigint) + block as sample_count, l_partkey % 50 as audio_bytes
    from lines join multi using (ok, part), (select unnest(range(2)) as block)""",
)
def _(t):
    found = C.block_headers(multi_files(t), KEYS)
    return found.select("ok", "part", *[c(x).cast("bigint").alias(x) for x in found.columns[2:]])


# Archives: one per nation and 50 customers, a root directory, a folder and files.
PER_ARCHIVE = 50
ARCHIVE_SQL = f"""{PLACED_SQL}, leaves as (select mix as nation, idx // {PER_ARCHIVE} as part,
        idx % {PER_ARCHIVE} + 2 as slot, track from numbered),
    toc as (select nation, part, slot as idx, case when track % 4 = 1 then 'resource' else 'binary' end as kind,
            'f' || track || case when track % 3 = 0 then '.AWC' else '.ysc' end as name,
            track % 5 as file_size, case when track % 4 = 1 then 0 else track * 3 end as unpacked,
            case when track % 4 = 1 then 0 else track % 2 end as crypt from leaves
        union all select distinct nation, part, 0, 'directory', '', 0, 0, 0 from leaves
        union all select distinct nation, part, 1, 'directory', 'Sub', 0, 0, 0 from leaves)"""


def archive_texts(t):
    """Archives as hex, one row per file."""
    placed = members(t)
    k = c("track")
    numbered = positions(placed, "mix", "track")
    parts = collect_parts(
        numbered.select("mix", "track", "idx"), "mix", "idx", k, "tracks", PER_ARCHIVE
    )
    ext = lambda x: F.when(x % 3 == 0, ".AWC").otherwise(".ysc")
    name = lambda x: F.concat(F.lit("f"), x.cast("string"), ext(x))
    # Every name takes 16 bytes of the blob, the root's is empty at 0.
    slot = lambda x: F.rpad(F.hex(F.encode(name(x), "UTF-8")), 32, "0")
    blob = F.concat(
        F.lit("00" * 16), F.lit("537562" + "00" * 13), F.array_join(F.transform("tracks", slot), "")
    )
    n = F.size("tracks")

    def entry(x, i):
        size = x % 5
        low = (i + 2) * 16 + F.shiftleft(size, 16)
        high = F.when(x % 4 == 1, F.lit(0x80000100)).otherwise(F.lit(0x100)).cast("bigint")
        rest = F.when(x % 4 == 1, F.lit("00" * 8)).otherwise(
            F.concat(little_hex(x * 3, 4), little_hex(x % 2, 4))
        )
        return F.concat(little_hex(low, 4), little_hex(high, 4), rest)

    def directory(offset, first, count):
        return F.concat(
            little_hex(F.lit(offset), 4), F.lit("00FFFF7F"), little_hex(F.lit(first), 4),
            little_hex(count, 4),
        )

    text = F.concat(
        F.lit("37465052"), little_hex(n + 2, 4), little_hex((n + 2) * 16, 4), F.lit("00000000"),
        directory(0, 1, F.lit(1)), directory(16, 2, n),
        F.array_join(F.transform("tracks", entry), ""), blob,
    )
    file = F.concat_ws("/", c("mix").cast("string"), c("part").cast("string"))
    return parts.select(file.alias("file"), text.alias("text"))


def archive_files(t):
    """The bytes, made once: operators read them many times."""
    ensure_checkpoint_dir(t.spark)
    return archive_texts(t).select("file", F.unhex("text").alias("content")).checkpoint()


@query(
    "archive_toc",
    f"""with {ARCHIVE_SQL} select nation || '/' || part as file, idx, kind, name,
        file_size::bigint as file_size, unpacked::bigint as unpacked_size,
        crypt::bigint as encryption_type from toc""",
)
def _(t):
    archives = archive_files(t).withColumn("start", F.lit(0).cast("bigint"))
    return C.archive_toc(archives).select(
        "file", "idx", "kind", "name", "file_size", "unpacked_size", "encryption_type"
    )


@query(
    "archive_entries",
    f"""with {ARCHIVE_SQL} select nation || '/' || part as file, idx,
        case idx when 0 then '' when 1 then 'sub' else 'sub/' || lower(name) end as path,
        case when kind = 'directory' then 0 when kind = 'binary' and (unpacked > 0 or file_size = 0)
            then unpacked else file_size end::bigint as size,
        kind <> 'directory' and file_size > 0 as is_compressed,
        (kind = 'binary' and crypt = 1) or (kind = 'resource' and lower(name) like '%.ysc') as is_encrypted
    from toc""",
)
def _(t):
    return T.archive_entries(archive_files(t)).select(
        "file", "idx", "path", "size", "is_compressed", "is_encrypted"
    )


# The same archives two levels deep: outer, mid.rpf, leaf.rpf. By nation the inner header is broken (1),
# mid.rpf has a root that names itself (2), an entry that is mid.rpf itself (3) or no root (4).

FAULT = "nation % 5"
NESTED_SQL = f"""{ARCHIVE_SQL}, parts as (select distinct nation, part, nation || '/' || part as file, {FAULT} as fault
        from leaves),
    nested as (select file, 0 as start, 0 as idx, '' as path from parts
        union all select file, 0, 1, 'mid.rpf' from parts
        union all select file, 512, 0, 'mid.rpf' from parts where fault <> 4
        union all select file, 512, 1, 'mid.rpf/leaf.rpf' from parts where fault <> 4
        union all select parts.file, 1024, idx, 'mid.rpf/leaf.rpf' || case idx when 0 then '' when 1 then '/sub'
            else '/sub/' || lower(name) end from toc join parts using (nation, part) where fault in (0, 2)),
    faults as (select file, 1024 as start, 'mid.rpf/leaf.rpf' as prefix, 'version' as reason, 1024 as "offset"
            from parts where fault = 1
        union all select file, 512, 'mid.rpf', 'cycle', 528 from parts where fault = 2
        union all select file, 512, 'mid.rpf', 'own_archive', 544 from parts where fault = 3
        union all select file, 512, 'mid.rpf', 'no_root', 512 from parts where fault = 4)"""


def _around(inner, name: str, root, sector=None):
    """Hex of an archive of one entry ``name``, which is the archive ``inner`` behind it (hex)."""
    size = F.floor(F.length(inner) / 2)
    high = F.shiftleft(F.lit(1) if sector is None else sector, 8).cast("bigint")
    entry = F.concat(little_hex(F.lit(16), 4), little_hex(high, 4), little_hex(size, 4), F.lit("00" * 4))
    names = F.lit("00" * 16 + name.encode().hex().ljust(32, "0"))
    head = F.concat(F.lit("37465052" + "02000000" + "20000000" + "00000000"), root, entry, names)
    return F.concat(F.rpad(head, 1024, "0"), inner)


def nested_files(t):
    fault = F.split_part("file", F.lit("/"), F.lit(1)).cast("int") % 5
    leaf = F.when(fault == 1, F.concat(F.lit("00000000"), F.substr("text", F.lit(9)))).otherwise(c("text"))
    plain = "00000000" + "00FFFF7F" + "01000000" + "01000000"
    root = F.when(fault == 2, "00000000" + "00FFFF7F" + "00000000" + "02000000").when(
        fault == 4, "00000000" + "00010000" + "00000000" + "00000000").otherwise(plain)
    mid = _around(leaf, "leaf.rpf", root, F.when(fault == 3, 0).otherwise(1))
    ensure_checkpoint_dir(t.spark)
    outer = F.unhex(_around(mid, "MID.rpf", F.lit(plain)))
    return archive_texts(t).select("file", outer.alias("content")).checkpoint()


@query("nested_archives", f"""with {NESTED_SQL} select file, start::bigint as start, idx::bigint as idx, path from nested""")
def _(t):
    return T.archive_entries(nested_files(t)).select("file", "start", c("idx").cast("bigint").alias("idx"), "path")


@query(
    "archive_faults",
    f"""with {NESTED_SQL} select file, start::bigint as start, prefix, reason, "offset"::bigint as "offset"
    from faults""",
)
def _(t):
    return T.archive_faults(nested_files(t))


@query(
    "entries_by_suffix",
    f"""with {ARCHIVE_SQL} select nation || '/' || part as file, idx, name from toc
    where lower(name) like '%.awc' and kind <> 'directory'""",
)
def _(t):
    archives = archive_files(t).withColumn("start", F.lit(0).cast("bigint"))
    return T.entries_by_suffix(C.archive_toc(archives), ".awc").select("file", "idx", "name")


@query(
    "directory_paths",
    """select n_nationkey, lower(r_name) || '/' || lower(n_name) as path
    from nation join region on n_regionkey = r_regionkey""",
)
def _(t):
    # Root 0, regions next, then the nations of each region side by side.
    regions = t.region.select("r_regionkey", "r_name")
    counts = regions.join(t.nation, c("r_regionkey") == c("n_regionkey"), "left").groupBy(
        "r_regionkey", "r_name"
    ).agg(F.count("n_nationkey").alias("n"))
    total = counts.agg(F.count(F.lit(1)).alias("dirs"), F.sum("n").alias("leaves"))
    dirs = total.select("dirs").scalar()
    size = total.select((c("dirs") + c("leaves") + 1).alias("x")).scalar()
    before = A.prefix_offsets(counts.withColumn("g", F.lit(0)), "g", ["r_regionkey"], c("n"), "first")
    zero = F.lit(0).cast("bigint")
    folder = before.select(
        (c("r_regionkey") + 1).cast("bigint").alias("idx"), c("r_name").alias("name"),
        F.lit("directory").alias("kind"), (c("first") + dirs + 1).alias("child_index"),
        c("n").alias("child_count"), F.lit(-1).alias("n_nationkey"),
    )
    spot = A.prefix_offsets(
        t.nation.withColumn("g", F.lit(0)), "g", ["n_regionkey", "n_nationkey"], F.lit(1), "place"
    )
    leaf = spot.select(
        (c("place") + dirs + 1).cast("bigint").alias("idx"), c("n_name").alias("name"),
        F.lit("binary").alias("kind"), zero.alias("child_index"), zero.alias("child_count"),
        "n_nationkey",
    )
    root = total.select(
        zero.alias("idx"), F.lit("").alias("name"), F.lit("directory").alias("kind"),
        F.lit(1).cast("bigint").alias("child_index"), c("dirs").alias("child_count"),
        F.lit(-1).alias("n_nationkey"),
    )
    toc = root.unionByName(folder).unionByName(leaf).withColumn("entry_count", size).withColumn(
        "file", F.lit("world")
    )
    paths = T.directory_paths(toc, ["file"])
    return paths.where("kind = 'binary'").select("n_nationkey", "path")


@query(
    "search_entries",
    """select page_id from pages where contains(lower(split_part(url, '/', -1)), 'ref=')
        or contains(lower(url), 'ref=')""",
)
def _(t):
    entries = t.pages.select("page_id", c("url").alias("path"), F.substring_index("url", "/", -1).alias("name"))
    return T.search_entries(entries, "  REF= ").select("page_id")


# The marks that occur in addresses, in the reader's order, as characters below the digits.
_MARKS = "_-:?./&#="
_ALPHABET = f"translate({{}}, '{_MARKS}', '{''.join(chr(i + 1) for i in range(len(_MARKS)))}')"


def _ranked(name: str, key: str, value: str, descending: bool = False):
    """Places of the pages as entries, by one of the three orders."""
    sql = f"""select page_id, row_number() over (order by {value} {'desc' if descending else 'asc'}, page_id)
        as place from pages"""

    @query(name, sql)
    def _(t):
        entries = t.pages.select(
            "page_id", F.length("html").alias("size"), c("url").alias("path"),
            F.substring_index("url", "/", -1).alias("name"))
        ranked = T.ranked_entries(entries, key, "page_id", descending)
        return ranked.select("page_id", c("place").cast("bigint").alias("place"))


_ranked("sort_entries", "size", "length(html)", descending=True)
_ranked("sort_entries_by_name", "name", _ALPHABET.format("split_part(url, '/', -1)"))
_ranked("sort_entries_by_path", "path", _ALPHABET.format("url"), descending=True)


@query(
    "scan_byte_ranges",
    """select doc_id, upper(hex(encode(text)))[2 * (doc_id % 40) + 1 : 2 * (doc_id % 40) + 48] as piece
    from documents""",
)
def _(t):
    data = c("text").cast("binary")
    piece = C.read_range(data, c("doc_id") % 40, F.lit(24))
    return t.documents.select("doc_id", F.hex(piece).alias("piece"))


@query(
    "archive_names",
    r"""with d as (select doc_id, upper(hex(encode(text))) as h, octet_length(encode(text)) as n from documents)
    select doc_id, case when doc_id % 50 < n then regexp_extract(h[2 * (doc_id % 50) + 1 :],
        '^((?:0[0-9B-F]|[1-9A-F][0-9A-F]){0,256})', 1) else '' end as name from d""",
)
def _(t):
    lines_end = F.regexp_replace(F.decode(c("text").cast("binary"), "ISO-8859-1"), "\n", "\0")
    blob = t.documents.select("doc_id", F.encode(lines_end, "ISO-8859-1").alias("blob"))
    name = C.archive_name(c("blob"), F.lit(0), F.length("blob").cast("bigint"), c("doc_id") % 50)
    return blob.select("doc_id", F.hex(F.encode(name, "ISO-8859-1")).alias("name"))


PCM_SQL = """raw as (select doc_id, hex(encode(text)) as h, octet_length(encode(text)) // 2 as n from documents),
    pcm as (select doc_id, n, unnest(range(0, n)) as frame, h from raw),
    words as (select doc_id, frame,
        case when doc_id % 2 = 0 then ('0x' || h[4 * frame + 3 : 4 * frame + 4] || h[4 * frame + 1 : 4 * frame + 2])::bigint
            else ('0x' || h[4 * frame + 1 : 4 * frame + 4])::bigint end as w from pcm),
    samples as (select doc_id, frame, (case when w >= 32768 then w - 65536 else w end) / 32768.0::double as v
        from words)"""


def pcm_blocks(t):
    return widen(t.documents).select(
        "doc_id", c("text").cast("binary").alias("bytes"), (c("doc_id") % 2 == 0).alias("little")
    )


@query(
    "pcm16_samples",
    f"""with {PCM_SQL} select doc_id, count(*) as frames, floor(sum(v) * 1e6 + 0.5) / 1e6 as total,
        min(v) as low, max(v) as high from samples group by doc_id""",
)
def _(t):
    decoded = pcm_blocks(t).select("doc_id", C.pcm16_samples("bytes", "little").alias("v"))
    wide = decoded.select("doc_id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return wide.select(
        "doc_id", F.size("v").cast("bigint").alias("frames"), S.fixed(total).alias("total"),
        F.array_min("v").alias("low"), F.array_max("v").alias("high"),
    )


@query(
    "pcm16_rows",
    f"""with {PCM_SQL} select doc_id, count(*) as frames, floor(sum(v * (frame % 7)) * 1e6 + 0.5) / 1e6
        as weighted from samples group by doc_id""",
)
def _(t):
    rows = C.pcm16_rows(pcm_blocks(t), ("doc_id",))
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("frames"),
        S.fixed(F.sum(c("value") * (c("frame") % 7))).alias("weighted"),
    )


# Blocks: a line is the channel of a block, an order is a block.


@query(
    "block_ranges",
    f"""with rows as (select l_orderkey, row_number() over (partition by l_orderkey order by {LINE_KEY}) - 1
            as channel, l_linenumber as sub, cast(l_quantity * 10 as bigint) as want from lineitem),
        head as (select l_orderkey, (24 * count(*) + 4 * sum(sub) + 2047) // 2048 * 2048 as pad
            from rows group by l_orderkey),
        p as (select r.*, pad, coalesce(sum(want) over (partition by r.l_orderkey order by channel
            rows between unbounded preceding and 1 preceding), 0) as before
            from rows r join head h on r.l_orderkey = h.l_orderkey),
        s as (select *, case when channel = 0 then pad + before else least(pad + before, 3000) end as start
            from p)
    select l_orderkey, channel, start::bigint as start, least(start + want, 3000)::bigint as "end",
        greatest(0, least(start + want, 3000) - start)::bigint as bytes from s""",
)
def _(t):
    numbered = A.renumber_rows(t.lineitem, "l_orderkey", LINE_ORDER, "channel")
    headers = numbered.select(
        "l_orderkey", "channel", c("l_linenumber").cast("bigint").alias("sub_blocks"),
        (c("l_quantity") * 10).cast("bigint").alias("audio_bytes"),
        F.lit(3000).cast("bigint").alias("block_length"),
    )
    return C.block_ranges(headers, ["l_orderkey"]).select(
        "l_orderkey", "channel", "start", "end", "bytes"
    )


LINES_SQL = """lines as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
        cast(l_quantity as bigint) as q, cast(floor(l_discount * 100 + 0.5) as bigint) as d from lineitem)"""


def lines(t):
    return t.lineitem.select(
        "l_orderkey", *LINE_ORDER, c("l_quantity").cast("bigint").alias("q"),
        F.floor(c("l_discount") * 100 + 0.5).cast("bigint").alias("d"),
    )


IDENT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "prefix_offsets",
    f"""with {LINES_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(coalesce(sum(q) over (
        partition by l_orderkey order by {LINE_KEY} rows between unbounded preceding and 1 preceding), 0)
        as bigint) as "offset" from lines""",
)
def _(t):
    return A.prefix_offsets(lines(t), "l_orderkey", LINE_ORDER, c("q"), "offset").select(*IDENT, "offset")


@query(
    "frame_offsets",
    f"""with {LINES_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey,
        cast(coalesce(sum(1152) over w, 0) as bigint) as sample_offset, count(*) over w as number
    from lines window w as (partition by l_orderkey order by {LINE_KEY}
        rows between unbounded preceding and 1 preceding)""",
)
def _(t):
    rows = lines(t).withColumn("sample_count", F.lit(1152).cast("bigint"))
    return A.frame_offsets(rows, "l_orderkey", LINE_ORDER).select(*IDENT, "sample_offset", "number")


@query(
    "block_output_offsets",
    f"""with {LINES_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(coalesce(
        sum(greatest(d - l_linenumber, 0)) over (partition by l_orderkey order by {LINE_KEY}
            rows between unbounded preceding and 1 preceding), 0) as bigint) as cursor,
        greatest(d - l_linenumber, 0)::bigint as kept from lines""",
)
def _(t):
    rows = lines(t).withColumn("sample_count", c("d")).withColumn(
        "discard", c("l_linenumber").cast("bigint")
    )
    return A.block_output_offsets(rows, "l_orderkey", LINE_ORDER).select(*IDENT, "cursor", "kept")


@query(
    "frame_at_sample",
    f"""with {LINES_SQL}, f as (select *, coalesce(sum(q) over (partition by l_orderkey order by {LINE_KEY}
            rows between unbounded preceding and 1 preceding), 0) as off from lines),
        p as (select o_orderkey, o_orderkey % 97 as sample from orders
            where o_orderkey in (select l_orderkey from lineitem)),
        tot as (select l_orderkey, sum(q) as n from lines group by l_orderkey)
    select p.o_orderkey, cast(case when p.sample >= n then -1 else max(off) end as bigint) as frame_start
    from p join tot t on t.l_orderkey = p.o_orderkey
        left join f on f.l_orderkey = p.o_orderkey and f.off <= p.sample group by p.o_orderkey, p.sample, n""",
)
def _(t):
    rows = lines(t).withColumn("sample_count", c("q")).withColumn("stream", c("l_orderkey"))
    frames = A.frames_in_order(rows, "stream", LINE_ORDER)
    probes = t.orders.select("o_orderkey", c("o_orderkey").alias("stream"),
                             (c("o_orderkey") % 97).alias("sample"))
    known = probes.join(rows.select("stream").distinct(), "stream", "left_semi")
    return A.frame_at_sample(frames, known, "stream").select("o_orderkey", "frame_start")


@query(
    "join_format_data",
    """select f.l_orderkey, f.stream, f.samples, d.size from
        (select l_orderkey, l_partkey % 5 as stream, cast(max(l_quantity) as bigint) as samples from lineitem
            where l_returnflag <> 'N' group by 1, 2) f
        join (select l_orderkey, l_partkey % 5 as stream, cast(floor(max(l_tax) * 100 + 0.5) as bigint) as size from lineitem
            where l_returnflag = 'N' group by 1, 2) d on f.l_orderkey = d.l_orderkey and f.stream = d.stream""",
)
def _(t):
    rows = t.lineitem.withColumn("stream", c("l_partkey") % 5)
    keys = ["l_orderkey", "stream"]
    formats = rows.where("l_returnflag <> 'N'").groupBy(*keys).agg(
        F.max("l_quantity").cast("bigint").alias("samples")
    )
    data = rows.where("l_returnflag = 'N'").groupBy(*keys).agg(
        F.floor(F.max("l_tax") * 100 + 0.5).alias("size")
    )
    return A.join_format_data(formats, data, keys)


LABEL_SQL = """streams as (select file, idx, 'song' || file || '_' || (idx // 2 + 1)
            || case when idx % 2 = 0 then '_left' else '_right' end as own
        from (select p_partkey as file, unnest(range(0, p_partkey % 4 * 2)) as idx from part
            where p_partkey % 4 > 0)),
    bytes as (select file, idx, list_transform(range(1, length(own) + 1),
        lambda i: ascii(substring(own, i, 1))::bigint) as b from streams),
    mixed as (select file, idx, list_reduce(list_prepend(0::bigint, b), lambda h, x:
        xor((h + x) * 1025 & 4294967295, ((h + x) * 1025 & 4294967295) >> 6)) as h from bytes),
    f1 as (select file, idx, (h + (h << 3)) & 4294967295 as h from mixed),
    f2 as (select file, idx, xor(h, h >> 11) as h from f1),
    hashed as (select file, idx, (h + (h << 15)) & 4294967295 & 536870911 as hash from f2)"""


@query(
    "resolve_labels",
    f"""with {LABEL_SQL} select file, 'Song' || file || '.AWC' as name, idx,
        case when idx % 5 = 3 then file + idx else hash end as hash,
        case when idx % 5 <> 3 then idx // 2 + 1 end as pair,
        case when idx % 5 <> 3 then case when idx % 2 = 0 then 'L' else 'R' end end as side,
        case when idx % 5 <> 3 then (idx // 2 + 1) || case when idx % 2 = 0 then ' LEFT' else ' RIGHT' end
            end as label from hashed""",
)
def _(t):
    """Streams hashed from their own names plus noise; the labels must come back."""
    p = c("p_partkey")
    pairs = widen(t.part).where("p_partkey % 4 > 0").select(
        p.alias("file"), F.concat(F.lit("Song"), p.cast("string"), F.lit(".AWC")).alias("name"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), p % 4 * 2 - 1)).alias("idx"),
    )
    base = F.concat(F.lit("song"), c("file").cast("string"))
    side = F.when(c("idx") % 2 == 0, "_left").otherwise("_right")
    own = F.concat(base, F.lit("_"), (F.floor(c("idx") / 2) + 1).cast("string"), side)
    noise = c("file") + c("idx")
    streams = pairs.select(
        "file", "name", "idx", F.when(c("idx") % 5 == 3, noise).otherwise(S.jenkins29(own)).alias("hash")
    )
    return A.resolve_labels(streams, "file", "name")


@query(
    "codec_breakdown",
    """with x as (select p_brand, p_type, count(*) as n, min(p_partkey) as first from part group by 1, 2),
    y as (select p_brand, upper(p_type) as p_type, sum(n) as n, min(first) as first from x group by 1, 2)
    select p_brand, string_agg(n || ' × ' || p_type, ' + ' order by first) as breakdown from y group by p_brand""",
)
def _(t):
    rows = t.part.select(c("p_brand").alias("file"), c("p_type").alias("codec"), c("p_partkey").alias("idx"))
    return A.codec_breakdown(rows, "file").withColumnRenamed("file", "p_brand")


@query(
    "file_summary",
    f"""with {LINES_SQL} select l_orderkey, count(*) as stems, coalesce(max(l_quantity / 3), 0.0) as duration_seconds,
        first(d order by {LINE_KEY}) as sample_rate, bool_or(l_suppkey % 7 = 0) as encrypted,
        count(case when l_suppkey % 3 = 0 then 1 end) as block_streams
    from lines group by l_orderkey""",
)
def _(t):
    rows = lines(t).select(
        "l_orderkey", F.struct(*LINE_ORDER).alias("idx"), (c("l_quantity") / 3).alias("duration_seconds"),
        c("d").alias("sample_rate"), (c("l_suppkey") % 7 == 0).alias("encrypted"),
        F.when(c("l_suppkey") % 3 == 0, F.lit(1)).alias("block_count"),
    )
    return A.file_summary(rows, "l_orderkey")


@query(
    "peek_join",
    """with s as (select l_orderkey, count(*) as stems, max(l_discount) as d from lineitem group by l_orderkey)
    select o_orderkey, case when o_orderkey % 9 <> 0 then stems end as stems,
        case when o_orderkey % 9 <> 0 and d > 0 then d end as duration_seconds,
        coalesce(o_orderkey % 9 = 0 or l_orderkey is null, true) as failed
    from orders left join s on l_orderkey = o_orderkey""",
)
def _(t):
    summary = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("stems"), F.max("l_discount").alias("duration_seconds")
    ).withColumn("failed", c("o_orderkey") % 9 == 0)
    return Z.peek_join(t.orders.select("o_orderkey"), summary, "o_orderkey")


FAILURES_SQL = """with e as (select 'decoder ' || user_id % 3 || ' gave up' as message, event_id from events
        where event_type = 'error')"""


@query(
    "failure_report",
    f"""{FAILURES_SQL} select message, count(*) as failures, min(event_id) as first_idx, max(event_id) as last_idx
    from e group by message""",
)
def _(t):
    return A.failure_report(_failures(t))


@query(
    "failed_streams",
    f"""{FAILURES_SQL} select message, row_number() over (partition by message order by event_id) - 1 as position,
        event_id as idx from e""",
)
def _(t):
    return A.failed_streams(_failures(t))


def _failures(t):
    message = F.concat(F.lit("decoder "), (c("user_id") % 3).cast("string"), F.lit(" gave up"))
    return t.events.where("event_type = 'error'").select(message.alias("message"), c("event_id").alias("idx"))


@query(
    "decode_progress",
    """with b as (select l_orderkey, l_linenumber, count(*) - 1 as n from lineitem group by 1, 2)
    select l_orderkey, cast(sum(greatest(n, 1)) as bigint) as total,
        cast(sum(case when l_linenumber % 2 = 0 then greatest(n, 1) else least(n, greatest(n, 1)) end) as bigint)
            as done,
        cast(floor(100.0 * sum(case when l_linenumber % 2 = 0 then greatest(n, 1)
            else least(n, greatest(n, 1)) end) / sum(greatest(n, 1)) + 0.5) as bigint) as percent
    from b group by l_orderkey""",
)
def _(t):
    stems = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        (F.count(F.lit(1)) - 1).alias("blocks")
    ).select("l_orderkey", "blocks", c("blocks").alias("blocks_done"),
             (c("l_linenumber") % 2 == 0).alias("finished"))
    return A.decode_progress(stems, "l_orderkey")


@query(
    "block_reconcile",
    f"""with {LINES_SQL}, got as (select l_orderkey, cast(sum(q - d) as bigint) as samples from lines group by 1)
    select o_orderkey, o_orderkey % 200 as declared, coalesce(samples, 0) as samples,
        coalesce(samples, 0) - o_orderkey % 200 as diff
    from orders left join got on l_orderkey = o_orderkey""",
)
def _(t):
    blocks = lines(t).select(c("l_orderkey").alias("o_orderkey"), c("q").alias("sample_count"), c("d").alias("discard"))
    declared = t.orders.select("o_orderkey", (c("o_orderkey") % 200).alias("declared"))
    return A.block_reconcile(blocks, declared, "o_orderkey")


@query(
    "needs_key",
    """select l_orderkey, bool_or(l_returnflag = 'R' and l_suppkey % 5 = 0) as needs_key
    from lineitem group by l_orderkey""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", ((c("l_returnflag") == "R") & (c("l_suppkey") % 5 == 0)).alias("encrypted"))
    return Q.needs_key(rows, "l_orderkey")


@query(
    "supported_codec",
    """with x as (select p_partkey, case p_size % 9 when 0 then 'pcm' when 4 then 'adpcm' when 7 then 'mp3'
        else 'unknown' end as codec from part)
    select p_partkey, codec, case when codec not in ('pcm', 'mp3') then 'unsupported codec ' || codec end as message
    from x""",
)
def _(t):
    rows = t.part.select("p_partkey", S.codec_name(c("p_size") % 9).alias("codec"))
    good, bad = Q.supported_codec(rows)
    return good.unionByName(bad, allowMissingColumns=True)


@query(
    "validate_records",
    """with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey * 300000 as hash,
            l_suppkey * 3 as codec_id, cast(l_quantity * 2000 as bigint) as sample_rate,
            l_linenumber - 2 as sample_count, l_discount - 0.01 as duration_seconds,
            case l_returnflag when 'R' then 'mp3' when 'A' then 'ogg' end as codec from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',',
        case when not (hash between 0 and 536870911) then 'hash' end,
        case when codec is null or codec not in ('pcm', 'mp3') then 'codec' end,
        case when codec_id > 255 then 'codec_id' end,
        case when sample_rate > 65535 then 'sample_rate' end,
        case when sample_count < 0 then 'sample_count' end,
        case when duration_seconds < 0 then 'duration_seconds' end) as violations from x""",
)
def _(t):
    p = c("l_partkey")
    codec = F.when(c("l_returnflag") == "R", "mp3").when(c("l_returnflag") == "A", "ogg")
    rows = t.lineitem.select(
        *IDENT, (p * 300000).alias("hash"), (c("l_suppkey") * 3).alias("codec_id"),
        (c("l_quantity") * 2000).cast("bigint").alias("sample_rate"),
        (c("l_linenumber") - 2).alias("sample_count"),
        (c("l_discount") - 0.01).alias("duration_seconds"), codec.alias("codec"),
        S.hash_hex(p * 131071 % 536870912).alias("hash_hex"),
    )
    checked = Q.validate_records(rows, Q.stream_rules())
    return checked.select(*IDENT, F.array_join("violations", ",").alias("violations"))


BOUNDS_SQL = """x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 60 - 3 as o,
        cast(l_quantity as bigint) - 2 as size from lineitem),
    b as (select *, case when o < 0 or o > 50 then 'offset_out_of_range'
        when size < 0 or o + size > 50 then 'size_past_end' end as reason from x)"""


def bounded(t):
    rows = t.lineitem.select(*IDENT, (c("l_partkey") % 60 - 3).alias("o"),
                             (c("l_quantity").cast("bigint") - 2).alias("s"))
    return Q.bounds_check(rows, c("o"), c("s"), F.lit(50))


@query(
    "bounds_check",
    f"""with {BOUNDS_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, reason,
        case when reason is not null then o end as "at" from b""",
)
def _(t):
    return bounded(t).select(*IDENT, "reason", "at")


@query(
    "quarantine",
    f"""with {BOUNDS_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, reason, o as "at" from b
        where reason is not null
    union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, null, null from b where reason is null""",
)
def _(t):
    rows = bounded(t).drop("at").withColumnRenamed("reason", "why")
    good, bad = Q.quarantine(rows, c("why"), c("o"))
    return good.select(*IDENT).unionByName(bad.select(*IDENT, "reason", "at"), allowMissingColumns=True)
