"""Sequential algorithms against windows, split folds and streams."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from timelane.operators import gates as G
from timelane.operators import history as H
from timelane.operators import keyframes as K

c = F.col


def push_log(n, seed, mixes=3):
    rng = random.Random(seed)
    out, ts = [], 1000
    for i in range(n):
        ts += rng.choice([0, 100, 250, 500, 501, 900])
        mix = 0 if rng.random() < 0.7 else rng.randrange(mixes)
        out.append((mix, ts, i, rng.choice([None, "a", "a", "b"]), f"l{i}", f"s{i}"))
    return out


LOG = "mix bigint, ts_ms bigint, ord bigint, edit_key string, label string, state string"


def coalesced(rows, gap=500):
    out = []
    tails = {}
    for mix, ts, ord_, key, label, state in sorted(rows, key=lambda r: (r[1], r[2])):
        tail = tails.get(mix)
        if tail and key is not None and tail[3] == key and ts - tail[4] <= gap:
            tail[2], tail[4], tail[6] = label, ts, tail[6] + 1
        else:
            tails[mix] = [mix, state, label, key, ts, ord_, 1]
            out.append(tails[mix])
    return sorted(map(tuple, out), key=lambda r: (r[0], r[5]))


@pytest.mark.parametrize("hot", ["1000000", "40"])
def test_coalesce_equals_sequential(spark, hot):
    rows = push_log(800, 3)
    spark.conf.set("spark.timelane.hotRows", hot)
    try:
        df = spark.createDataFrame(rows, LOG)
        got = H.coalesce_edits(df, "mix").select(
            "mix", "state", "label", "edit_key", "pushed_ms", "first_ord", "merged")
        assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[5])) == coalesced(rows)
    finally:
        spark.conf.unset("spark.timelane.hotRows")


def test_coalesce_examples(spark):
    rows = [(0, 1000, 0, "k", "a", "s0"), (0, 1100, 1, "k", "b", "s1"), (0, 1200, 2, "k", "c", "s2"),
            (1, 1000, 3, "k", "a", "s3"), (1, 2000, 4, "k", "b", "s4")]
    got = H.coalesce_edits(spark.createDataFrame(rows, LOG), "mix").orderBy("mix", "first_ord").collect()
    assert [(r.state, r.label, r.merged) for r in got] == [("s0", "c", 3), ("s3", "a", 1), ("s4", "b", 1)]
    many = [(0, 1000 * i, i, None, "x", f"s{i}") for i in range(105)]
    kept = H.cap_history(H.coalesce_edits(spark.createDataFrame(many, LOG), "mix"), "mix")
    assert kept.count() == 100 and kept.agg(F.min("first_ord")).first()[0] == 5


def test_undo_redo_walkthrough(spark):
    ops = [("push", 1000, "k", "a", "s0"), ("push", 1100, "k", "b", "s1"), ("push", 2000, None, "c", "s2"),
           ("undo", 2100, None, None, "now"), ("redo", 2200, None, None, "then"),
           ("undo", 2300, None, None, "x"), ("undo", 2400, None, None, "y"), ("undo", 2500, None, None, "z"),
           ("push", 3000, None, "d", "s3"), ("redo", 3100, None, None, "w"), ("clear", 3200, None, None, None)]
    rows = [("m", i, *o) for i, o in enumerate(ops)]
    df = spark.createDataFrame(
        rows, "mix string, ord bigint, op string, ts_ms bigint, edit_key string, label string, state string")
    got = H.undo_redo(df, "mix").orderBy("ord").collect()
    assert [(r.past, r.future, r.restored) for r in got] == [
        (1, 0, None), (1, 0, None), (2, 0, None), (1, 1, "s2"), (2, 0, "now"), (1, 1, "then"),
        (0, 2, "s0"), (0, 2, None), (1, 0, None), (1, 0, None), (0, 0, None)]


def frames(n, seed):
    rng = random.Random(seed)
    out, ms = [], 0
    for i in range(n):
        ms += rng.choice([5, 16, 16, 40, 300, 1500])
        series = "hot" if rng.random() < 0.8 else rng.choice(["a", "b"])
        out.append((series, i, ms, ms / 1000, round(rng.random() ** 3, 3)))
    return out


FRAME = "series string, ord bigint, ts_ms bigint, at double, peak double"


def by_key(rows, step):
    names = ["series", "ord", "ts_ms", "at", "peak"]
    pdf = pd.DataFrame(rows, columns=names).assign(position=lambda d: d.peak, op="", state="")
    return pd.concat([step(None, g.sort_values(["ts_ms", "ord"]))[1] for _, g in pdf.groupby("series")])


@pytest.mark.parametrize("limit", [10**6, 60])
def test_split_folds_equal_plain_folds(spark, limit):
    rows = frames(700, 9)
    df = spark.createDataFrame(rows, FRAME).withColumn("position", c("peak")).repartition(4)
    held = G.peak_hold(df, "series", ["ts_ms", "ord"], rows_per_chunk=limit)
    want = by_key(rows, G.peak_hold_step())
    assert {(r.series, r.ord, r.hold) for r in held.collect()} == set(
        zip(want.series, want.ord, want.hold))
    for got, step in (
        (G.throttle(df, "series", ["ts_ms", "ord"], rows_per_chunk=limit), G.throttle_step()),
        (G.delta_filter(df, "series", ["ts_ms", "ord"], 0.3, rows_per_chunk=limit), G.delta_step(0.3)),
    ):
        want = by_key(rows, step)
        assert {(r.series, r.ord) for r in got.collect()} == set(zip(want.series, want.ord))


def test_split_undo_equals_plain(spark):
    rng = random.Random(4)
    rows = [("m", i, rng.choice(["push", "push", "undo", "redo"]), i * 300, rng.choice([None, "k"]),
             f"l{i}", f"s{i}") for i in range(260)]
    df = spark.createDataFrame(
        rows, "mix string, ord bigint, op string, ts_ms bigint, edit_key string, label string, state string")
    plain = H.undo_redo(df, "mix").collect()
    split = H.undo_redo(df, "mix", rows_per_chunk=90).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, split))


def test_normalize_equals_sequential(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        t = rng.choice([-1.0, 0.0, 1.0, 1.0 + 4e-10, 2.0, 3.5, float("nan"), float("inf")])
        g = rng.choice([-0.2, 0.5, 1.7, float("nan")])
        rows.append((i % 7, t, g, rng.choice(["hold", "linear", "?", None]), i))
    want = []
    for key in range(7):
        clean = [[max(0.0, t), min(1.5, max(0.0, g)), "hold" if e == "hold" else "linear", o]
                 for k, t, g, e, o in rows if k == key and abs(t) < 1e300 and g == g]
        clean.sort(key=lambda r: r[0])
        out = []
        for r in clean:
            if out and abs(out[-1][0] - r[0]) < 1e-9:
                out[-1] = r
            else:
                out.append(r)
        want += [(key, *r) for r in out]
    df = spark.createDataFrame(rows, "k int, time double, gain double, easing string, ord bigint")
    got = K.normalize_keyframes(df, "k").select("k", "time", "gain", "easing", "ord")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_envelope_examples(spark):
    kf = [("p", 0.0, 1.0, "linear", 0), ("p", 10.0, 0.5, "linear", 1), ("p", 20.0, 0.8, "hold", 2),
          ("p", 30.0, 0.2, "linear", 3), ("q", 5.0, 0.7, "linear", 4)]
    df = spark.createDataFrame(kf, "k string, time double, gain double, easing string, ord bigint")
    probes = [("p", t) for t in (-5.0, 5.0, 15.0, 19.999, 20.0, 30.0, 999.0)] + [
        ("q", 0.0), ("q", 5.0), ("q", 9.0), ("none", 1.0)]
    got = K.envelope_at(spark.createDataFrame(probes, "k string, at double"), df, "k").collect()
    assert sorted((r.k, r.at, r.envelope, r.inside) for r in got if r.k != "none") == [
        ("p", -5.0, 1.0, False), ("p", 5.0, 0.75, True), ("p", 15.0, 0.5, True),
        ("p", 19.999, 0.5, True), ("p", 20.0, 0.8, True), ("p", 30.0, 0.2, True),
        ("p", 999.0, 0.2, False), ("q", 0.0, 0.7, False), ("q", 5.0, 0.7, True), ("q", 9.0, 0.7, False)]
    assert [(r.envelope, r.inside) for r in got if r.k == "none"] == [(None, False)]
