import math

import pytest
from pyspark.sql import functions as F

from timelane.functions import bits, scalars, text


def ask(spark, rows, schema, **cols):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_bits_both_orders_and_bounds(spark):
    data = bytes([0x41, 0x44, 0xFF, 0xFE, 0xC3, 0xA9])
    x = F.col("x")
    got = ask(
        spark, [(bytearray(data),)], "x binary",
        le=bits.u32(x, 0), be=bits.u32(x, 0, False), s=bits.i16(x, 2, False),
        past=bits.u32(x, 3), far=bits.u16(x, F.lit(1 << 40)), one=bits.u8(x, 5),
        col=bits.u32(x, 0, F.lit(True)),
    )[0]
    assert got == {
        "le": int.from_bytes(data[:4], "little"), "be": int.from_bytes(data[:4], "big"),
        "s": -2, "past": None, "far": None, "one": 0xA9,
        "col": int.from_bytes(data[:4], "little"),
    }


def test_effective_gain_table(spark):
    rows = [
        (0.8, False, False, False, 0.8), (0.8, True, False, False, 0.0),
        (0.8, False, False, True, 0.0), (0.8, True, True, True, 0.8),
        (0.8, False, True, True, 0.8),
    ]
    got = ask(
        spark, rows, "g double, m boolean, s boolean, a boolean, want double",
        got=scalars.effective_gain(F.col("g"), F.col("m"), F.col("s"), F.col("a")),
        want=F.col("want"),
    )
    assert all(r["got"] == r["want"] for r in got)


def jenkins(s):
    h = 0
    for b in s.lower().encode():
        h = (h + b) & 0xFFFFFFFF
        h = (h + (h << 10)) & 0xFFFFFFFF
        h ^= h >> 6
    h = (h + (h << 3)) & 0xFFFFFFFF
    h ^= h >> 11
    return (h + (h << 15)) & 0xFFFFFFFF & 0x1FFFFFFF


def test_jenkins29(spark):
    words = ["", "a", "Track_1_left", "été über", "x" * 300]
    got = ask(spark, [(w,) for w in words], "w string", h=scalars.jenkins29(F.col("w")))
    assert [r["h"] for r in got] == [jenkins(w) for w in words]


@pytest.mark.parametrize(
    "word,want",
    [
        # version 1, layer III, 48 kHz, 128 kbit/s, joint stereo, no CRC
        (0xFFFB9440 | 0x40, (True, 10, 3, 128000, 48000, 2, 1152, 384)),
        (0xFFFA9440, (True, 10, 3, 128000, 48000, 2, 1152, 384)),
        (0xFFE39440, (True, 25, 3, 80000, 12000, 2, 576, 960)),
        (0xFFEB9440, (False,) + (None,) * 7),
        (0xFFF99440, (False,) + (None,) * 7),
        (0xFFFBF440, (False,) + (None,) * 7),
        (0xFFFB9C40, (False,) + (None,) * 7),
        (0x12345678, (False,) + (None,) * 7),
    ],
)
def test_frame_header(spark, word, want):
    f = scalars.frame_header_fields(F.col("w"))
    names = ["valid", "version", "layer", "bit_rate", "sample_rate", "channels",
             "sample_count", "frame_size"]
    got = ask(spark, [(word,)], "w bigint", **{n: f[n] for n in names})[0]
    assert got == dict(zip(names, want))


def test_quantize_truncates(spark):
    rows = [(-2.0,), (-1.0,), (-0.5,), (-0.00001,), (0.0,), (0.5,), (1.0,), (3.0,)]
    got = ask(spark, rows, "v double", q=scalars.quantize_pcm16(F.col("v")))
    assert [r["q"] for r in got] == [-32768, -32768, -16384, 0, 0, 16383, 32767, 32767]


def test_durations(spark):
    rows = [(None,), (-1.0,), (0.0,), (59.6,), (61.25,), (math.inf,)]
    s = F.col("s")
    got = ask(spark, rows, "s double", **{m: text.format_duration(s, m) for m in
                                          ("listing", "short", "readout", "precise")})
    assert [r["listing"] for r in got] == ["-", "-", "-", "1:00", "1:01", "-"]
    assert [r["short"] for r in got] == ["-", "-", "0:00", "0:59", "1:01", "-"]
    assert [r["readout"] for r in got] == ["0:00", "0:00", "0:00", "0:59", "1:01", "0:00"]
    assert [r["precise"] for r in got] == [
        "0:00.00", "0:00.00", "0:00.00", "0:59.60", "1:01.25", "0:00.00"]


def test_text_helpers(spark):
    c = F.col("x")
    rows = [("  12.5px ",), ("",), ("abc",), ("-.5",), ("1e400",), ("+3.",)]
    got = ask(spark, rows, "x string", n=text.parse_number(c))
    assert [r["n"] for r in got] == [12.5, None, None, -0.5, None, 3.0]
    rows = [("a/b/c.TXT",), ("plain",), ("/x",)]
    got = ask(spark, rows, "x string", p=text.path_parent(c), n=text.path_name(c),
              k=text.classify_file(c, {".txt": "text"}))
    assert [(r["p"], r["n"], r["k"]) for r in got] == [
        ("a/b", "c.TXT", "text"), ("", "plain", None), ("", "x", None)]
    rows = [("__A b!!c__",), ("1 LEFT+RIGHT",)]
    assert [r["s"] for r in ask(spark, rows, "x string", s=text.safe_name(c))] == [
        "A_b_c", "1_LEFT+RIGHT"]
    rows = [("pair-12",), ("pair-",), ("xpair-1",), (None,)]
    assert [r["i"] for r in ask(spark, rows, "x string", i=text.pair_key_index(c))] == [
        12, None, None, None]


def test_sizes_ages_gains(spark):
    n = F.col("n")
    rows = [(1023,), (1024,), (1536,), (3 << 20,), (5 << 30,)]
    assert [r["b"] for r in ask(spark, rows, "n bigint", b=text.format_bytes(n))] == [
        "1023 B", "1.0 KiB", "1.5 KiB", "3.0 MiB", "5.00 GiB"]
    rows = [(-5,), (59_000,), (60_000,), (3_600_000,), (90_000_000,)]
    assert [r["a"] for r in ask(spark, rows, "n bigint", a=text.format_age(n))] == [
        "just now", "just now", "1m ago", "1h ago", "1d ago"]
    g = F.col("g")
    got = ask(spark, [(0.0,), (1.0,), (0.5,), (1.5,)], "g double",
              d=text.gain_db(g), p=text.gain_percent(g))
    assert [r["d"] for r in got] == ["-∞", "+0.0", "-6.0", "+3.5"]
    assert [r["p"] for r in got] == ["0%", "100%", "50%", "150%"]


def test_to_fixed_rounds_the_binary_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    rows = [(1.005,), (0.125,), (-0.04,), (2.675,), (1.45,), (8.345,), (1e9 + 0.115,), (0.0,)]
    got = ask(spark, rows, "x double", a=text.to_fixed(F.col("x"), 2))
    want = [str(Decimal(x).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)) for (x,) in rows]
    assert [r["a"] for r in got] == want
