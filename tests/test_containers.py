"""Byte-level fixtures in both byte orders, built by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from timelane.operators import trees as T
from timelane.session import ensure_checkpoint_dir
from timelane.sources import containers as C


def container(little, streams, payloads, flags=0, version=1, magic=b"ADAT", data_offset=None):
    """``streams``: (id, [(type, payload index, size override)])."""
    e = "<" if little else ">"
    n = len(streams)
    skip = 2 * n if flags & 1 else 0
    total = sum(len(ch) for _, ch in streams)
    body_at = 16 + skip + 4 * n + 8 * total
    offsets, at = [], body_at
    for p in payloads:
        offsets.append(at)
        at += len(p)
    tag = magic if little else magic[::-1]
    out = tag + struct.pack(e + "HHII", version, flags, n, body_at if data_offset is None else data_offset)
    out += b"\0" * skip
    for sid, chunks in streams:
        out += struct.pack(e + "I", (len(chunks) << 29) | sid)
    for _, chunks in streams:
        for kind, index, size in chunks:
            value = (kind << 56) | ((len(payloads[index]) if size is None else size) << 28) | offsets[index]
            out += struct.pack(e + "Q", value)
    return out + b"".join(payloads)


def fmt(little, samples, rate, codec, loop=-1):
    e = "<" if little else ">"
    return struct.pack(e + "IiHhHHHBB", samples, loop, rate, -7, 1, 2, 3, 4, codec)


def kept(df):
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def files(spark, *contents):
    rows = [(f"f{i}", bytearray(b)) for i, b in enumerate(contents)]
    return spark.createDataFrame(rows, "file string, content binary")


@pytest.mark.parametrize("little", [True, False])
def test_mono_container(spark, little):
    data = struct.pack(("<" if little else ">") + "4h", 1, -2, 32767, -32768)
    body = container(
        little,
        [(0x1ABCDE, [(0xFA, 0, None), (0x55, 2, None)]), (7, [(0xFA, 1, None), (0x36, 2, None)])],
        [fmt(little, 4, 48000, 0), fmt(little, 9, 0, 7), data], flags=1 | 2,
    )
    df = files(spark, body)
    index = kept(C.container_index(df))
    h = C.container_header(index).first()
    assert (h.reason, h.endianness, h.stream_count, h.chunk_indices, h.multi_channel) == (
        None, "LE" if little else "BE", 2, True, False)
    chunks = C.container_chunks(index)
    got = sorted((r.chunk, r.id, r.type, r.size) for r in chunks.collect())
    assert got == [(0, 0x1ABCDE, 0xFA, 20), (1, 0x1ABCDE, 0x55, 8), (2, 7, 0xFA, 20), (3, 7, 0x36, 8)]
    f = {r.id: r for r in C.container_formats(chunks).collect()}
    assert (f[0x1ABCDE].loop_point, f[0x1ABCDE].headroom, f[0x1ABCDE].play_begin) == (-1, -7, 4)
    s = C.playable_streams(index).collect()
    assert [(r.hash, r.codec, r.duration_seconds, r.encrypted) for r in s] == [
        (0x1ABCDE, "pcm", 4 / 48000, True)]
    payload = df.select(
        C.read_range(F.col("content"), F.lit(s[0].data_offset), F.lit(s[0].data_size)).alias("bytes"),
        F.lit(little).alias("little"), "file")
    samples = payload.select(C.pcm16_samples("bytes", "little").alias("v")).first().v
    assert samples == [1 / 32768, -2 / 32768, 32767 / 32768, -1.0]
    rows = C.pcm16_rows(payload).orderBy("frame").collect()
    assert [r.value for r in rows] == samples


def test_header_faults(spark):
    good = container(True, [], [b"x" * 20])
    df = files(
        spark, good, b"short", b"JUNK" + good[4:], container(True, [], [], version=2),
        good[:8] + struct.pack("<I", 70000) + good[12:], container(True, [], [], data_offset=999),
    )
    got = {r.file: (r.reason, r.offset) for r in C.container_header(C.container_index(df)).collect()}
    assert got == {
        "f0": (None, None), "f1": ("short_header", 0), "f2": ("magic", 0), "f3": ("version", 4),
        "f4": ("stream_count", 8), "f5": ("data_offset", 12)}


def test_chunk_bounds(spark):
    body = container(True, [(1, [(0x55, 0, 999)]), (2, [(0x55, 0, None)])], [b"ab"])
    index = kept(C.container_index(files(spark, body)))
    got = sorted((r.chunk, r.reason) for r in C.container_chunks(index).collect())
    assert got == [(0, "size_past_end"), (1, None)]
    assert C.playable_streams(index).count() == 0


@pytest.mark.parametrize("little", [True, False])
def test_multi_channel_blocks(spark, little):
    e = "<" if little else ">"
    size = 0x800 + 64

    def block(rows, length):
        head = b"".join(struct.pack("<6i", 0, sub, dis, cnt, 0, by) for sub, dis, cnt, by in rows)
        return (head + b"\0" * length)[:length]

    rows = [[(1, 0, 10, 40), (2, 3, 10, 40), (0, 0, 5, 10)], [(0, 1, 4, 20), (0, 0, 4, 5), (0, 0, 1, 1)]]
    data = block(rows[0], size) + block(rows[1], 0x800 + 22)
    sf = struct.pack(e + "3I", 3, size, 3) + b"".join(
        struct.pack(e + "IIhHBBH", i, 100 + i, -1, 48000, 7, 0, 0) for i in range(3))
    body = container(little, [(9, [(0x48, 0, None), (0x55, 1, None)])], [sf, data], flags=4 | 8)
    df = files(spark, body)
    s = sorted((r.idx, r.hash, r.sample_count, r.encrypted, r.block_count)
               for r in C.playable_streams(kept(C.container_index(df))).collect())
    assert s == [(0, 0, 100, True, 3), (1, 1, 101, True, 3), (2, 2, 102, True, 3)]
    got = C.block_ranges(C.block_headers(df)).orderBy("block", "channel").collect()
    assert [(r.block, r.channel, r.start, r.end, r.bytes, r.discard) for r in got] == [
        (0, 0, 0x800, 0x828, 40, 0), (0, 1, 0x828, 0x840, 24, 3), (0, 2, 0x840, 0x840, 0, 0),
        (1, 0, 0x800, 0x814, 20, 1), (1, 1, 0x814, 0x816, 2, 0), (1, 2, 0x816, 0x816, 0, 0)]


def archive(entries, names, payload=b"", magic=0x52504637, enc=0x4E45504F):
    blob = b"\0".join(n.encode() for n in names) + b"\0"
    offsets, at = [], 0
    for n in names:
        offsets.append(at)
        at += len(n) + 1
    out = struct.pack("<4I", magic, len(entries), len(blob), enc)
    for kind, name, *rest in entries:
        if kind == "d":
            out += struct.pack("<4I", offsets[name], 0x7FFFFF00, *rest)
        else:
            size, sector, unpacked, crypt = rest
            value = offsets[name] | (size << 16) | (sector << 40)
            if kind == "r":
                value |= 1 << 63
            out += struct.pack("<QII", value, unpacked, crypt)
    out += blob
    return out + b"\0" * (-len(out) % 512) + payload


def test_nested_archive(spark):
    inner = archive(
        [("d", 0, 1, 1), ("b", 1, 0, 1, 33, 0), ("b", 2, 0, 9, 1, 0)], ["", "Song.AWC", "lost.bin"])
    outer = archive(
        [("d", 0, 1, 3), ("d", 1, 4, 1), ("b", 2, 0, 1, len(inner), 0), ("r", 3, 77, 5, 0, 0),
         ("b", 4, 12, 6, 40, 1)],
        ["", "Dir", "In.RPF", "run.YSC", "x.bin"], inner)
    df = files(spark, outer, archive([], []), b"zz", archive([("d", 0, 5, 9)], [""]))
    rows = T.archive_entries(df).orderBy("start", "idx").collect()
    got = [(r.path, r.name, r.kind, r.size, r.is_compressed, r.is_encrypted) for r in rows]
    assert got == [
        ("", "", "directory", 0, False, False),
        ("dir", "dir", "directory", 0, False, False),
        ("in.rpf", "in.rpf", "binary", len(inner), False, False),
        ("run.ysc", "run.ysc", "resource", 77, True, True),
        ("dir/x.bin", "x.bin", "binary", 40, True, True),
        ("in.rpf", "", "directory", 0, False, False),
        ("in.rpf/song.awc", "song.awc", "binary", 33, False, False),
        ("in.rpf", "lost.bin", "binary", 1, False, False),
    ]
    faults = {r.file: r.reason for r in T.archive_faults(df).collect()}
    assert faults == {"f1": "entry_count", "f2": "short_header", "f3": "range_out_of_bounds"}
    toc = C.archive_toc(df.withColumn("start", F.lit(0).cast("bigint")))
    assert [(r.file, r.reason) for r in T.bad_directories(toc, ["file", "start"]).collect()] == [
        ("f3", "range_out_of_bounds")]


def test_faults_end_and_are_listed(spark):
    cycle = archive([("d", 0, 1, 2), ("d", 1, 0, 2), ("b", 2, 7, 1, 7, 0)], ["", "a", "x.bin"])
    shared = archive([("d", 0, 1, 2), ("d", 1, 3, 1), ("d", 2, 3, 1), ("b", 3, 5, 1, 5, 0)], ["", "a", "b", "x.bin"])
    myself = archive([("d", 0, 1, 1), ("b", 1, 0, 0, 99, 0)], ["", "me.rpf"])
    rootless = archive([("b", 0, 3, 1, 3, 0)], ["x.bin"])
    broken = archive([("d", 0, 1, 2), ("b", 1, 0, 1, 40, 0), ("b", 2, 0, 1, 9, 0)], ["", "in.rpf", "y.bin"], b"nothing" * 8)
    fine = archive([("d", 0, 1, 1), ("b", 1, 4, 1, 4, 0)], ["", "z.bin"])
    df = files(spark, cycle, shared, myself, rootless, broken, fine)
    entries, faults = T.walk_archives(df)
    paths = sorted((r.file, r.path) for r in entries.collect())
    assert paths == [("f0", ""), ("f0", "a"), ("f0", "x.bin"), ("f1", ""), ("f1", "a"), ("f1", "b"), ("f1", "b/x.bin"),
                     ("f2", ""), ("f2", "me.rpf"), ("f4", ""), ("f4", "in.rpf"), ("f4", "y.bin"), ("f5", ""), ("f5", "z.bin")]
    got = sorted((r.file, r.start, r.prefix, r.reason, r.offset) for r in faults.collect())
    assert got == [("f0", 0, "", "cycle", 16), ("f0", 0, "", "named_twice", 32), ("f1", 0, "", "named_twice", 64),
                   ("f2", 0, "", "own_archive", 32), ("f3", 0, "", "no_root", 0), ("f4", 512, "in.rpf", "version", 512)]


def test_scan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.awc").write_bytes(container(True, [], [b"x" * 4]))
    (tmp_path / "sub" / "b.awc").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")
    df = C.scan_files(spark, str(tmp_path), "*.awc")
    assert sorted(r.length for r in df.select("length").collect()) == [3, 20]
    assert {r.reason for r in C.container_header(C.container_index(df)).collect()} == {None, "short_header"}


def test_search_and_sort(spark):
    rows = [(0, "a/Beta.txt", "Beta.txt", 4, "binary"), (1, "b/alpha.TXT", "alpha.TXT", 3, "binary"),
            (2, "c/dir", "dir", 3, "directory"), (3, "z", "élan", 9, "binary")]
    df = spark.createDataFrame(rows, "ord int, path string, name string, size int, kind string")
    assert [r.ord for r in T.search_entries(df, " ALPHA ").collect()] == [1]
    assert T.search_entries(df, "  ").count() == 4
    assert [r.ord for r in T.sort_entries(df, "size", "ord", True).collect()] == [3, 0, 1, 2]
    assert [r.ord for r in T.sort_entries(df, "name", "ord").collect()] == [1, 0, 2, 3]
    assert [r.ord for r in T.entries_by_suffix(df, ".txt").orderBy("ord").collect()] == [0, 1]


@pytest.mark.parametrize("little", [True, False, None])
def test_pcm_rows_around_the_edges_of_words_and_blocks(spark, little):
    sizes = [0, 1, 2, 3, 7, 8, 9, 4095, 4096, 4097, 4103, 8192, 12289]
    data = [bytes((37 * i + 11 * n) % 256 for i in range(n)) for n in sizes]
    rows = [(i, bytearray(x), little) for i, x in enumerate([*data, data[4]])] + [(99, None, little)]
    got = C.pcm16_rows(spark.createDataFrame(rows, "file int, bytes binary, little boolean")).collect()
    want = [(i, k, v / 32768) for i, x in enumerate([*data, data[4]])
            for k, (v,) in enumerate(struct.iter_unpack("<h" if little else ">h", x[: len(x) // 2 * 2]))]
    assert sorted((r.file, r.frame, r.value) for r in got) == want
