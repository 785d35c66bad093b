"""Containers are read inside the row of their file, once, whatever the file's size."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from timelane.functions.bits import little_hex, long_at, u16, u32
from timelane.sources import containers as C


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _files(spark, *contents):
    rows = [(f"f{i}", bytearray(x)) for i, x in enumerate(contents)]
    return spark.createDataFrame(rows, "file string, content binary").coalesce(1)


def _multi(channels: int = 2, order: str = "<") -> bytes:
    body = 16 + 4 + 16
    fmt = struct.pack(order + "III", 1, 24 * channels, channels)
    fmt += b"".join(struct.pack(order + "IIhHB3x", 100 + i, 7 * i, -i, 32000, 4) for i in range(channels))
    data = b"".join(struct.pack("<iiiiii", 0, 5 + i, -i, 1000 + i, 0, 9 - i) for i in range(channels))

    def record(kind, size, at):
        return struct.pack(order + "Q", kind << 56 | size << 28 | at)

    magic = struct.pack("<I", C.MAGIC_LITTLE if order == "<" else C.MAGIC_BIG)
    head = magic + struct.pack(order + "HHII", 1, 4, 1, body) + struct.pack(order + "I", 2 << 29 | 77)
    return head + record(0x48, len(fmt), body) + record(0x55, len(data), body + len(fmt)) + fmt + data


def test_chunks_find_their_stream_without_a_shuffle_or_a_second_reading(spark):
    index = C.container_index(_files(spark, _multi(), _multi(3, ">")))
    plan = _plan(C.container_chunks(index))
    assert "Join" not in plan and "Window" not in plan
    for read in (C.container_chunks(index), C.container_streams(index)):
        assert not [x for x in _plan(read).splitlines() if "Filter" in x and "conv(" in x]
    got = C.container_chunks(index).orderBy("file", "chunk").collect()
    assert [(r.file, r.chunk, r.type, r.ordinal, r.id) for r in got] == [
        (f, i, t, 0, 77) for f in ("f0", "f1") for i, t in enumerate((0x48, 0x55))]
    channels = [[(x.id, x.samples, x.headroom, x.sample_rate, x.codec_id) for x in r.stream_format.channels]
                for r in got if r.type == 0x48]
    assert channels == [[(100 + i, 7 * i, -i, 32000, 4) for i in range(n)] for n in (2, 3)]


def test_block_headers_carry_no_file_bytes_behind_their_row(spark):
    found = C.block_headers(_files(spark, _multi(), _multi(2, ">")))
    lines = _plan(found).splitlines()
    assert not [x for x in lines if "Filter" in x and "conv(" in x]
    last = max(i for i, x in enumerate(lines) if "Generate" in x)
    assert not any("content#" in x for x in lines[:last])
    got = found.orderBy("file", "channel").collect()
    assert [(r.sub_blocks, r.discard, r.sample_count, r.audio_bytes) for r in got] == [
        (5 + i, -i, 1000 + i, 9 - i) for i in range(2)] * 2


def test_numbers_in_both_orders_and_short_reads(spark):
    df = spark.createDataFrame([(bytearray(range(249, 256)) + b"\x01", True), (bytearray(range(1, 9)), False)],
                               "d binary, little boolean")
    c = F.col
    rows = df.select(
        u32(c("d"), 1, c("little")), u16(c("d"), 6, c("little")), u32(c("d"), 5, c("little")),
        long_at(c("d"), 0, c("little")), long_at(c("d"), 1, c("little")), little_hex(F.lit(0x12AB), 4)).collect()
    one, two = bytes(range(249, 256)) + b"\x01", bytes(range(1, 9))
    assert list(rows[0])[:4] == [int.from_bytes(one[1:5], "little"), int.from_bytes(one[6:], "little"), None,
                                 int.from_bytes(one, "little")]
    assert list(rows[1])[:4] == [int.from_bytes(two[1:5], "big"), int.from_bytes(two[6:], "big"), None,
                                 int.from_bytes(two, "big")]
    assert [r[4] for r in rows] == [None, None] and rows[0][5] == "AB120000"


def test_pcm_rows_carry_no_bytes_of_their_file(spark):
    """A row per sample with the whole range beside it grew with the square of the range."""
    files = _files(spark, bytes(200_000)).select("file", F.col("content").alias("bytes"), F.lit(True).alias("little"))
    found = C.pcm16_rows(files)
    lines = _plan(found).splitlines()
    kept = [x.rsplit("), ", 1)[-1] for x in lines if "Generate" in x]
    assert kept and not any("bytes#" in x for x in [*kept, *lines[: max(i for i, x in enumerate(lines) if "Generate" in x)]])
    assert found.count() == 100_000
