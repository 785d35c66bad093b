"""Audio containers and archives as tables.

Input is one row per file with ``file`` and ``content`` (the binary file source, or any
binary column). Bytes are read where the file row is: every operator unpacks what it needs
and drops ``content`` before anything is shuffled, so only narrow records move.
Failures become a ``reason`` and an ``offset`` column.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelane.functions import scalars as S
from timelane.functions.bits import (
    bytes_at, field, has_bit, i16, i32, let, long_at, reversed_digits, signed, turned, u8, u16, u32,
)
from timelane.operators.ordered import biggest, ordered

c = F.col

# The container and archive formats.
MAGIC_LITTLE = 0x54414441
MAGIC_BIG = 0x41444154
HEADER_SIZE, STREAM_SIZE, CHUNK_SIZE = 16, 4, 8
CHUNK_DATA, CHUNK_FORMAT, CHUNK_STREAM_FORMAT = 0x55, 0xFA, 0x48
MAX_STREAMS, MAX_CHANNELS = 0xFFFF, 0x10000
CHANNEL_HEADER, BLOCK_PAD = 24, 0x800
ARCHIVE_VERSION = 0x52504637
SLOT_SIZE, SECTOR, NAME_LIMIT = 16, 512, 256
DIRECTORY_MARK = 0x7FFFFF00
MAX_ENTRIES, MAX_NAMES = 0x00FFFFFF, 0x10000000
PLAIN_ARCHIVES = (0x00000000, 0x4E45504F)
ARCHIVE_SUFFIX, CONTAINER_SUFFIX = ".rpf", ".awc"


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files of a folder tree: file, length, content. Unused content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(c("path").alias("file"), "length", "content")


def _range(n: Column) -> Column:
    """0 .. n-1, empty for 0."""
    some = F.sequence(F.lit(0), (n - 1).cast("int"))
    return F.when(n > 0, some).otherwise(F.array().cast("array<int>"))


def _indexed(files: DataFrame) -> DataFrame:
    """File rows with header fields, ``words`` (stream table) and ``records`` (chunk table).

    Everything a container says about itself is read in one visit to its bytes. The tables
    are arrays inside the row; the format bounds them (65,535 streams, 7 chunks each).
    """
    data, little = c("content"), c("little")
    head = (
        files.withColumn("magic", u32(data, 0))
        .withColumn("little", c("magic") == MAGIC_LITTLE)
        .withColumn("version", u16(data, 4, little)).withColumn("flags", u16(data, 6, little))
        .withColumn("stream_count", u32(data, 8, little))
        .withColumn("data_offset", u32(data, 12, little))
        .withColumn("file_size", F.length(data).cast("bigint"))
    )
    reason = (
        F.when(c("file_size") < HEADER_SIZE, "short_header")
        .when(~c("magic").isin(MAGIC_LITTLE, MAGIC_BIG), "magic")
        .when(c("version") != 1, "version")
        .when(c("stream_count") > MAX_STREAMS, "stream_count")
        .when(
            (c("data_offset") < HEADER_SIZE) | (c("data_offset") > c("file_size")), "data_offset"
        )
    )
    at = F.when(c("reason") == "version", 4).when(c("reason") == "stream_count", 8).when(
        c("reason") == "data_offset", 12
    ).when(c("reason").isNotNull(), 0)
    skipped = F.when(has_bit(c("flags"), 1), c("stream_count") * 2).otherwise(0)
    streams_at = (F.lit(HEADER_SIZE) + skipped).cast("bigint")
    readable = F.when(c("reason").isNull(), c("stream_count"))
    words = F.transform(
        _range(readable), lambda i: u32(data, c("streams_at") + i * STREAM_SIZE, little)
    )
    total = F.aggregate(
        c("words"), F.lit(0).cast("bigint"),
        lambda a, w: a + F.coalesce(field(w, 29, 7), F.lit(0).cast("bigint")),
    )
    chunks_at = c("streams_at") + c("stream_count") * STREAM_SIZE
    return (
        head.withColumn("reason", reason).withColumn("offset", at.cast("bigint"))
        .withColumn("streams_at", streams_at).withColumn("words", words)
        .withColumn("total", total).withColumn("chunks_at", chunks_at)
        .withColumn("records", F.transform(_range(c("total")), _record))
    )


def _record(j: Column) -> Column:
    """One chunk record: 8 bits of type, 28 of size, 28 of offset, and its payload."""
    data, little = c("content"), c("little")
    base = c("chunks_at") + j * CHUNK_SIZE

    def parts(p):
        lo = F.when(little, p["a"]).otherwise(p["b"])
        hi = F.when(little, p["b"]).otherwise(p["a"])
        return F.struct(
            field(hi, 24, 0xFF).alias("type"),
            (F.shiftleft(field(hi, 0, 0xFFFFFF), 4) + field(lo, 28, 0xF)).alias("size"),
            field(lo, 0, 0x0FFFFFFF).alias("offset"),
        )

    def cut(v):
        # In either byte order the 64 bits are type, size and offset; a cut record is read by halves.
        pair = F.struct(u32(data, base, little).alias("a"), u32(data, base + 4, little).alias("b"))
        return F.when(v.isNotNull(), F.struct(
            field(v, 56, 0xFF).alias("type"), field(v, 28, 0x0FFFFFFF).alias("size"),
            field(v, 0, 0x0FFFFFFF).alias("offset"),
        )).otherwise(let(pair, parts))

    def whole(r):
        multi = F.when(r["type"] == CHUNK_STREAM_FORMAT, _stream_format(r["offset"]))
        return let(multi, lambda m: F.struct(
            j.cast("bigint").alias("chunk"), r["type"].alias("type"), r["size"].alias("size"),
            r["offset"].alias("offset"),
            F.when(r["type"].isNull(), "table_past_end")
            .when(r["offset"] > c("file_size"), "offset_past_end")
            .when(r["offset"] + r["size"] > c("file_size"), "size_past_end")
            .when(m["channel_count"] > MAX_CHANNELS, "channel_count").alias("reason"),
            F.when(r["type"] == CHUNK_FORMAT, _format(r["offset"])).alias("format"),
            m.alias("stream_format"),
        ))

    return let(let(long_at(data, base, little), cut), whole)


def _halves(v: Column) -> tuple[Column, Column]:
    """The two 32-bit numbers of 64 bits in file order."""
    low, high = field(v, 0, 0xFFFFFFFF), field(v, 32, 0xFFFFFFFF)
    return F.when(c("little"), low).otherwise(high), F.when(c("little"), high).otherwise(low)


def _part(v: Column, little_shift: int, big_shift: int, mask: int) -> Column:
    return F.when(c("little"), field(v, little_shift, mask)).otherwise(field(v, big_shift, mask))


def _format(at: Column) -> Column:
    data, little = c("content"), c("little")
    single = F.struct(
        u32(data, at, little).alias("samples"), i32(data, at + 4, little).alias("loop_point"),
        u16(data, at + 8, little).alias("sample_rate"),
        i16(data, at + 10, little).alias("headroom"),
        u16(data, at + 12, little).alias("loop_begin"),
        u16(data, at + 14, little).alias("loop_end"),
        u16(data, at + 16, little).alias("play_end"), u8(data, at + 18).alias("play_begin"),
        u8(data, at + 19).alias("codec_id"),
    )

    def build(x):
        first, second = _halves(x["a"])
        # Where the whole payload is there, three reads are enough.
        return F.when(x["a"].isNotNull() & x["b"].isNotNull() & x["d"].isNotNull(), F.struct(
            first.alias("samples"), signed(second, 32).alias("loop_point"),
            _part(x["b"], 0, 48, 0xFFFF).alias("sample_rate"),
            signed(_part(x["b"], 16, 32, 0xFFFF), 16).alias("headroom"),
            _part(x["b"], 32, 16, 0xFFFF).alias("loop_begin"),
            _part(x["b"], 48, 0, 0xFFFF).alias("loop_end"),
            _part(x["d"], 0, 16, 0xFFFF).alias("play_end"),
            _part(x["d"], 16, 8, 0xFF).alias("play_begin"),
            _part(x["d"], 24, 0, 0xFF).alias("codec_id"),
        )).otherwise(single)

    return let(F.struct(
        long_at(data, at, little).alias("a"), long_at(data, at + 8, little).alias("b"),
        u32(data, at + 16, little).alias("d"),
    ), build)


def _stream_format(at: Column) -> Column:
    data, little = c("content"), c("little")

    def channel(i):
        co = at + 12 + i * 16
        single = F.struct(
            u32(data, co, little).alias("id"), u32(data, co + 4, little).alias("samples"),
            i16(data, co + 8, little).alias("headroom"),
            u16(data, co + 10, little).alias("sample_rate"), u8(data, co + 12).alias("codec_id"),
        )

        def whole(x):
            first, second = _halves(x["a"])
            return F.when(x["a"].isNotNull() & x["b"].isNotNull(), F.struct(
                first.alias("id"), second.alias("samples"),
                signed(_part(x["b"], 0, 48, 0xFFFF), 16).alias("headroom"),
                _part(x["b"], 16, 32, 0xFFFF).alias("sample_rate"),
                _part(x["b"], 32, 24, 0xFF).alias("codec_id"),
            )).otherwise(single)

        return let(F.struct(
            long_at(data, co, little).alias("a"), long_at(data, co + 8, little).alias("b")), whole)

    def build(count):
        sane = F.when(count <= MAX_CHANNELS, count)
        return F.struct(
            u32(data, at, little).alias("block_count"),
            u32(data, at + 4, little).alias("block_size"), count.alias("channel_count"),
            F.transform(_range(sane), channel).alias("channels"),
        )

    return let(u32(data, at + 8, little), build)


def container_index(files: DataFrame) -> DataFrame:
    """The narrow table the operators below work on. It holds no payload bytes: write it
    or checkpoint it once, and the files need not be read again."""
    keys = [x for x in files.columns if x not in ("content", "length")]
    return _indexed(files).select(
        *keys, "reason", "offset", "little", "version", "flags", "stream_count", "data_offset",
        "file_size", "words", "records",
    )


def container_header(index: DataFrame, keys=("file",)) -> DataFrame:
    """Header fields, or the reason and the place of the first fault."""
    ok = c("reason").isNull()
    end = F.when(c("little"), "LE").otherwise("BE").alias("endianness")
    rows = index.select("*", end)
    fields = ("endianness", "version", "flags", "stream_count", "data_offset")
    return rows.select(
        *keys, "reason", "offset", *[F.when(ok, c(x)).alias(x) for x in fields],
        *[F.when(ok, f).alias(n) for n, f in S.flag_bits(c("flags")).items()],
    )


def container_streams(index: DataFrame, keys=("file",)) -> DataFrame:
    """Stream records in file order; ``id`` is null where the table passes the end."""
    def stream(w, i):
        return F.struct(i.cast("bigint").alias("ordinal"), field(w, 0, 0x1FFFFFFF).alias("id"),
                        field(w, 29, 7).alias("chunk_count"))

    # Of a plain column Spark asks first whether it has elements, and reads the bytes twice.
    return index.select(*keys, F.explode(F.transform("words", stream)).alias("x")).select(*keys, "x.*")


def chunk_records(index: DataFrame, keys=("file",)) -> DataFrame:
    """Chunk records with decoded payloads, before owners are known. ``format`` is filled
    for format chunks, ``stream_format`` for multi-channel formats, nothing for others."""
    return index.select(*keys, F.explode(F.slice("records", F.lit(1), F.size("records"))).alias("r")).select(
        *keys, "r.*")


def _known(keys) -> Column:
    return reduce(lambda a, b: a & b, [c(k).isNotNull() for k in keys])


def _owners() -> Column:
    """Stream of every chunk number, in the order of the chunk table."""
    def own(w, i):
        stream = F.struct(i.cast("bigint").alias("ordinal"), field(w, 0, 0x1FFFFFFF).alias("id"))
        return F.array_repeat(stream, F.coalesce(field(w, 29, 7), F.lit(0)).cast("int"))

    return F.flatten(F.transform("words", own))


def container_chunks(index: DataFrame, keys=("file",)) -> DataFrame:
    """Chunk records with their owning stream, the one whose running count covers the chunk.

    Both tables of a file are in its row, so nothing is shuffled.
    """
    rows = index.where(_known(keys)).select(
        *keys, F.explode(F.arrays_zip(c("records").alias("r"), _owners().alias("o"))).alias("x"))
    return rows.select(*keys, "x.r.*", "x.o.*")


def container_formats(chunks: DataFrame, keys=("file",)) -> DataFrame:
    """The last format per stream id."""
    rows = chunks.where(c("format").isNotNull())
    fields = chunks.schema["format"].dataType.names
    # Numbers one by one: rows with a struct would have to be sorted to be aggregated.
    return rows.groupBy(*keys, "id").agg(*[F.max_by(c("format")[x], "chunk").alias(x) for x in fields])


def stream_format(chunks: DataFrame, keys=("file",)) -> DataFrame:
    """The first multi-channel format of each file."""
    rows = chunks.where(c("stream_format").isNotNull())
    return rows.groupBy(*keys).agg(F.min_by("stream_format", "chunk").alias("s")).select(
        *keys, "s.*"
    )


def _sound(layout: Column) -> Column:
    """Asked inside the row: a filter would have Spark read the bytes once for it and once more behind it."""
    return layout & c("reason").isNull() & ~F.exists("records", lambda r: r["reason"].isNotNull())


def _flag(name: str) -> Column:
    return has_bit(c("flags"), S.FLAG_BITS[name])


def _first(kind: int) -> Column:
    return F.get(F.filter("records", lambda r: r["type"] == kind), F.lit(0))


def mono_streams(index: DataFrame, keys=("file",)) -> DataFrame:
    """Streams of sound files that own a format and a data chunk, in stream order.

    Ids may repeat in a file: the last chunk of an id counts for all streams of that id. So
    streams and chunks go to their id together, in one shuffle.
    """
    keys = list(keys)

    def entry(id_, idx, chunk, fmt, data):
        return F.struct(id_.alias("id"), idx.cast("bigint").alias("idx"), chunk.cast("bigint").alias("chunk"),
                        fmt.alias("f"), data.alias("d"))

    none = F.lit(None)
    fmt = "struct<samples:bigint,sample_rate:bigint,codec_id:bigint>"
    place = "struct<offset:bigint,size:bigint>"
    streams = F.transform("words", lambda w, i: entry(
        field(w, 0, 0x1FFFFFFF), i, none, none.cast(fmt), none.cast(place)))
    used = F.filter(F.arrays_zip(c("records").alias("r"), _owners().alias("o")),
                    lambda x: x["r"]["type"].isin(CHUNK_FORMAT, CHUNK_DATA))
    chunks = F.transform(used, lambda x: let(x["r"], lambda r: entry(
        x["o"]["id"], none, r["chunk"],
        F.when(r["type"] == CHUNK_FORMAT, F.struct(*[r["format"][n].alias(n) for n in (
            "samples", "sample_rate", "codec_id")])),
        F.when(r["type"] == CHUNK_DATA, F.struct(r["offset"].alias("offset"), r["size"].alias("size"))))))
    rows = index.where(_known(keys)).select(
        *keys, _flag("single_channel_encrypt").alias("encrypted"),
        F.explode(F.when(_sound(~_flag("multi_channel")), F.concat(streams, chunks))).alias("x"),
    ).select(*keys, "encrypted", "x.*").where(c("id").isNotNull())
    w = W.partitionBy(*keys, "id").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = [F.last(x, ignorenulls=True).over(w).alias(x) for x in ("f", "d")]
    found = rows.select(*keys, "id", "idx", "encrypted", *last).where(
        c("idx").isNotNull() & c("f").isNotNull() & c("d").isNotNull())
    return found.select(
        *keys, "id", "idx", "encrypted", "f.*", c("d.offset").alias("data_offset"), c("d.size").alias("data_size"),
    ).select(*keys, "idx", *_stream_fields(), F.lit("mono").alias("layout"), "encrypted", "data_offset",
             "data_size", F.lit(None).cast("bigint").alias("block_count"))


def multi_streams(index: DataFrame, keys=("file",)) -> DataFrame:
    """Channels of the first stream format of sound multi-channel files."""
    rows = index.where(_known(keys)).select(
        *keys, _flag("multi_channel_encrypt").alias("encrypted"), _first(CHUNK_DATA).alias("d"),
        F.when(_sound(_flag("multi_channel")), _first(CHUNK_STREAM_FORMAT)["stream_format"]).alias("s"),
    )
    channels = rows.select(
        *keys, "encrypted", c("d.offset").alias("data_offset"), c("d.size").alias("data_size"), "s.block_count",
        F.posexplode(F.when(c("d").isNotNull(), c("s.channels"))).alias("idx", "ch"),
    )
    return channels.select(
        *keys, c("idx").cast("bigint").alias("idx"), "encrypted", "data_offset", "data_size",
        "block_count", "ch.*",
    ).select(*keys, "idx", *_stream_fields(), F.lit("mc-channel").alias("layout"), "encrypted",
             "data_offset", "data_size", "block_count")


def _stream_fields():
    return [
        c("id").alias("hash"), S.hash_hex(c("id")).alias("hash_hex"),
        S.codec_name(c("codec_id")).alias("codec"), c("codec_id"), c("sample_rate"),
        c("samples").alias("sample_count"),
        S.duration_seconds(c("samples"), c("sample_rate")).alias("duration_seconds"),
    ]


def playable_streams(index: DataFrame, keys=("file",)) -> DataFrame:
    """Streams of both layouts; files with a chunk outside their bytes give none."""
    return mono_streams(index, keys).unionByName(multi_streams(index, keys))


def block_headers(files: DataFrame, keys=("file",)) -> DataFrame:
    """Channel headers of every block of multi-channel files.

    The first stream format and the first data chunk are looked up inside the file's own
    row, and the header bytes of each block are cut out there, so the file's bytes are never joined,
    moved or repeated. Returns the rows of :func:`block_ranges`.
    """
    rows = _indexed(files).select(
        *keys, "content", (c("reason").isNull() & _flag("multi_channel")).alias("multi"),
        _first(CHUNK_STREAM_FORMAT)["stream_format"].alias("f"), _first(CHUNK_DATA).alias("d"),
    ).select(
        *keys, "content", "multi", "f.block_count", "f.block_size", "f.channel_count",
        c("d.offset").alias("data_offset"), c("d.size").alias("data_size"),
    )
    size = c("block_size")
    # Blocks behind the data have no bytes, however many the format declares.
    count = F.when(size > 0, F.least(c("block_count"), F.ceil(c("data_size") / size))).otherwise(0)

    def block(i):
        srcoff = i * size
        length = F.greatest(F.least(size, c("data_size") - srcoff), F.lit(0))
        return let(c("data_offset") + srcoff, lambda at: F.struct(
            i.cast("bigint").alias("block"), at.alias("at"), length.alias("block_length"),
            bytes_at(c("content"), at, c("channel_count") * CHANNEL_HEADER).alias("head")))

    blocks = F.filter(F.transform(_range(count), block), lambda b: b["block_length"] > 0)
    rows = rows.select(*keys, "channel_count", F.explode(
        F.when(c("multi") & (c("channel_count") <= MAX_CHANNELS), blocks)).alias("b")).select(*keys, "channel_count", "b.*")
    # One short row per header: its numbers are read by compiled expressions, not inside an array.
    raw = F.transform(_range(c("channel_count")), lambda ch: bytes_at(c("head"), ch * CHANNEL_HEADER, CHANNEL_HEADER))
    rows = rows.select(*keys, "block", c("at").alias("block_start"), "block_length",
                       F.posexplode(raw).alias("channel", "raw"))
    fields = {"sub_blocks": 4, "discard": 8, "sample_count": 12, "audio_bytes": 20}
    rows = rows.select(
        *keys, "block", c("channel").cast("bigint").alias("channel"), "block_start", "block_length",
        *[reversed_digits(bytes_at(c("raw"), at, 4), 4).alias(n) for n, at in fields.items()])
    return rows.select(*rows.columns[:-4], *[signed(turned(c(n), 4), 32).alias(n) for n in fields])


def block_ranges(headers: DataFrame, keys=("file", "block"), rows_per_chunk=None) -> DataFrame:
    """Byte range of each channel inside its block.

    Audio starts behind the padded headers; channels follow each other and the last ones
    are clipped at the block's end.
    """
    keys = list(keys)
    total = headers.groupBy(*keys).agg(
        (F.count(F.lit(1)) * CHANNEL_HEADER + F.sum("sub_blocks") * 4).alias("_head")
    )
    padded = F.shiftleft(F.shiftright(c("_head") + (BLOCK_PAD - 1), 11), 11)
    sized = headers.join(total.select(*keys, padded.alias("_pad")), keys)
    bound = biggest(headers, keys)
    placed = ordered(sized, keys, ["channel"], rows_per_chunk, bound).scan(
        before={"_before": c("audio_bytes")}, number="_n"
    ).df
    raw = c("_pad") + c("_before")
    start = F.when(c("_n") == 1, raw).otherwise(F.least(raw, c("block_length")))
    end = F.least(start + c("audio_bytes"), c("block_length"))
    return (
        placed.withColumn("start", start).withColumn("end", end)
        .withColumn("bytes", F.greatest(F.lit(0), c("end") - c("start")))
        .drop("_pad", "_before", "_n")
    )


PCM_BYTES = 4_000_000
"""Bytes of PCM that a task decodes at once, or one row that is larger."""


@F.arrow_udf(T.ArrayType(T.FloatType()))
def pcm16_samples(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Samples in -1..1 of 16-bit PCM bytes; an odd last byte is dropped."""
    import numpy as np
    import pyarrow.compute as pc

    def decode(raw, le):
        if raw is None:
            return np.empty(0, "float32")
        samples = np.frombuffer(raw, "<i2" if le else ">i2", raw.size // 2)
        return samples.astype("float32") / np.float32(32768)

    for data, little in batches:
        lengths = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype("int64")
        piece = (np.cumsum(lengths) - lengths) // PCM_BYTES
        for begin, end in zip(*_runs_of(piece)):
            some, le = data.slice(begin, end - begin), little.slice(begin, end - begin)
            rows = [decode(d.as_buffer() if d.is_valid else None, f.as_py()) for d, f in zip(some, le)]
            ends = np.cumsum([0, *map(len, rows)])
            absent = some.is_null().to_numpy(zero_copy_only=False)
            starts = pa.array(ends, pa.int32(), mask=np.append(absent, False))
            yield pa.ListArray.from_arrays(starts, pa.array(np.concatenate(rows)))


def _runs_of(numbers):
    """Begins and ends of the runs of equal numbers."""
    import numpy as np

    cuts = np.flatnonzero(np.diff(numbers)) + 1
    return [0, *cuts.tolist()][:len(numbers)], [*cuts.tolist(), len(numbers)]


PCM_BLOCK = 4096
EACH_LOW_BYTE = 0x00FF00FF00FF00FF


def pcm16_rows(blocks: DataFrame, keys=("file",)) -> DataFrame:
    """Samples of ``bytes`` as rows by expressions alone.

    No row behind the first cut holds ``bytes``: they become blocks of PCM_BLOCK bytes, those words of
    four samples, those samples. A task holds one row's bytes, its blocks and one block's samples.
    """
    data, block, word = c("bytes"), c("_block"), c("_word")
    pieces = F.transform(
        _range(F.ceil(F.length(data) / PCM_BLOCK)), lambda i: bytes_at(data, i * PCM_BLOCK, PCM_BLOCK))
    cut = blocks.select(*keys, "little", F.posexplode(pieces).alias("_at", "_block"))
    read = F.transform(
        _range(F.ceil(F.length(block) / 8)),
        lambda i: F.conv(F.rpad(F.hex(bytes_at(block, i * 8, 8)), 16, "0"), 16, -10).cast("bigint"))
    words = cut.withColumn("_samples", F.floor(F.length(block) / 2)).select(
        *keys, "little", "_at", "_samples", F.posexplode(read).alias("_nth", "_word"))
    low = F.lit(EACH_LOW_BYTE).cast("bigint")
    swapped = F.shiftleft(word.bitwiseAND(low), 8).bitwiseOR(F.shiftrightunsigned(word, 8).bitwiseAND(low))
    samples = words.withColumn("_word", F.when(c("little"), swapped).otherwise(word)).select(
        *keys, "_at", "_samples", "_nth",
        F.posexplode(F.array(*[field(word, k, 0xFFFF) for k in (48, 32, 16, 0)])).alias("_sub", "_value"))
    within = c("_nth") * 4 + c("_sub")
    return samples.where(within < c("_samples")).select(
        *keys, (c("_at").cast("bigint") * (PCM_BLOCK // 2) + within).alias("frame"),
        (signed(c("_value"), 16) / 32768.0).alias("value"))


# Archives


def archive_header(archives: DataFrame) -> DataFrame:
    """Adds ``entry_count``, ``names_length``, ``encryption``, ``reason``, ``offset``.

    ``start`` is the archive's place in the content (0 for the file itself).
    """
    data, at = c("content"), c("start")
    version = u32(data, at)
    rows = (
        archives.withColumn("_version", version)
        .withColumn("entry_count", u32(data, at + 4))
        .withColumn("names_length", u32(data, at + 8))
        .withColumn("encryption", u32(data, at + 12))
    )
    end = at + HEADER_SIZE + c("entry_count") * SLOT_SIZE
    reason = (
        F.when(c("encryption").isNull(), "short_header")
        .when(c("_version") != ARCHIVE_VERSION, "version")
        .when((c("entry_count") == 0) | (c("entry_count") > MAX_ENTRIES), "entry_count")
        .when(c("names_length") > MAX_NAMES, "names_length")
        .when(~c("encryption").isin(*PLAIN_ARCHIVES), "encrypted")
        .when(end > F.length(data), "table_past_end")
    )
    where = (
        F.when(c("reason").isin("short_header", "version"), 0)
        .when(c("reason") == "entry_count", 4).when(c("reason") == "names_length", 8)
        .when(c("reason") == "encrypted", 12).when(c("reason") == "table_past_end", 16)
    )
    return rows.withColumn("reason", reason).withColumn("offset", at + where).drop("_version")


def archive_name(data: Column, names_at: Column, names_length: Column, offset: Column) -> Column:
    """Zero-ended name at an offset of the names blob, cut at 256 bytes, '' outside."""
    size = F.least(F.lit(NAME_LIMIT), names_length - offset)
    raw = bytes_at(data, names_at + offset, F.greatest(F.lit(0), size))
    text = F.substring_index(F.decode(raw, "ISO-8859-1"), "\0", 1)
    return F.when((offset >= 0) & (offset < names_length), text).otherwise("")


def archive_toc(archives: DataFrame, keys=("file", "start")) -> DataFrame:
    """Entry slots in stored order with their names; bad archives give no rows."""
    good = archive_header(archives).where(c("reason").isNull())
    rows = good.select(
        *keys, "content", "entry_count", "names_length",
        (c("start") + HEADER_SIZE).alias("slots_at"),
        F.explode(_range(c("entry_count"))).alias("idx"),
    )
    data = c("content")
    at = c("slots_at") + c("idx") * SLOT_SIZE
    words = rows.select(
        "*", u32(data, at).alias("y"), u32(data, at + 4).alias("x"),
        u32(data, at + 8).alias("w2"), u32(data, at + 12).alias("w3"),
    )
    x, y = c("x"), c("y")
    kind = (
        F.when(x == DIRECTORY_MARK, S.DIRECTORY).when(~has_bit(x, 0x80000000), S.BINARY)
        .otherwise(S.RESOURCE)
    )
    is_dir = c("kind") == S.DIRECTORY
    is_bin = c("kind") == S.BINARY
    zero = F.lit(0).cast("bigint")
    offset = F.when(is_dir, y).otherwise(field(y, 0, 0xFFFF))
    size = field(y, 16, 0xFFFF) + F.shiftleft(field(x, 0, 0xFF), 16)
    place = F.when(is_bin, field(x, 8, 0xFFFFFF)).otherwise(field(x, 8, 0x7FFFFF))
    named = words.withColumn("kind", kind).withColumn("name_offset", offset)
    name = archive_name(
        data, c("slots_at") + c("entry_count") * SLOT_SIZE, c("names_length"), c("name_offset")
    )
    return named.select(
        *keys, c("idx").cast("bigint").alias("idx"), "kind", name.alias("name"), "entry_count",
        F.when(is_dir, c("w2")).otherwise(zero).alias("child_index"),
        F.when(is_dir, c("w3")).otherwise(zero).alias("child_count"),
        F.when(is_dir, zero).otherwise(size).alias("file_size"),
        F.when(is_dir, zero).otherwise(place).alias("file_offset"),
        F.when(is_bin, c("w2")).otherwise(zero).alias("unpacked_size"),
        F.when(is_bin, c("w3")).otherwise(zero).alias("encryption_type"),
    )


def read_range(content: Column, offset: Column, length: Column) -> Column:
    """Payload bytes of an entry."""
    return bytes_at(content, offset, length)
