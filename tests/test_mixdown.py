"""Mixdown against loops over samples, and where its plan exchanges rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from timelane.operators import keyframes as K
from timelane.operators import mix as M

c = F.col
RATE, BLOCK = 8.0, 6
TRACKS = "mix string, track bigint, gain double, pan double, muted boolean, solo boolean"
BLOCKS = "mix string, track bigint, start bigint, values array<double>"
KEYFRAMES = "mix string, track bigint, time double, gain double, easing string, ord bigint"


def material(seed, tracks=23):
    """Tracks of uneven length in two mixes, most of them in one, and keyframes for some."""
    rng = random.Random(seed)
    rows, blocks, frames = [], [], []
    for t in range(tracks):
        mix = "hot" if t % 7 else "small"
        rows.append((mix, t, rng.random(), rng.uniform(-1, 1), rng.random() < 0.3, False))
        length = rng.randint(0, 40)
        samples = [rng.uniform(-1, 1) for _ in range(length)]
        blocks += [(mix, t, s, samples[s:s + BLOCK]) for s in range(0, length, BLOCK)]
        times = sorted(rng.sample(range(40), rng.choice([0, 1, 2, 5])))
        frames += [(mix, t, x / 8 + rng.choice([0, 0.03]), rng.random(), rng.choice(["hold", "linear"]), i)
                   for i, x in enumerate(times)]
    return rows, blocks, frames


def plain(rows, blocks, keyframes, master):
    import math

    out = {}
    solo = {m for m, *_, s in rows if s}
    longest = {}
    for mix, t, start, values in blocks:
        longest[mix] = max(longest.get(mix, 0), start + len(values))
    for mix, n in longest.items():
        out |= {(mix, f): [0.0, 0.0] for f in range(n)}
    for mix, t, gain, pan, muted, alone in rows:
        if not (alone if mix in solo else not muted):
            continue
        kf = sorted((x, g, e) for m, k, x, g, e, _ in keyframes if (m, k) == (mix, t))
        for _, _, start, values in (b for b in blocks if b[:2] == (mix, t)):
            for i, v in enumerate(values):
                at = (start + i) / RATE
                g = gain
                if kf and kf[0][0] <= at <= kf[-1][0]:
                    g = kf[-1][1]
                    for (t0, g0, _), (t1, g1, e1) in zip(kf, kf[1:]):
                        if t0 <= at < t1:
                            g = g0 if e1 == "hold" else g0 + (g1 - g0) * (at - t0) / (t1 - t0)
                x = (pan + 1) / 2 * math.pi / 2
                out[mix, start + i][0] += v * g * math.cos(x) * master
                out[mix, start + i][1] += v * g * math.sin(x) * master
    return out


@pytest.mark.parametrize("part", [256, 2])
@pytest.mark.parametrize("automated", [True, False])
def test_equals_loops(spark, monkeypatch, part, automated):
    monkeypatch.setattr(M, "TRACKS_IN_PART", part)
    monkeypatch.setattr("timelane.operators.sums.CELLS", 20)  # a few rows at a time
    rows, blocks, keyframes = material(3)
    kfs = K.normal_order(spark.createDataFrame(keyframes, KEYFRAMES), ["mix", "track"]) if automated else None
    got = M.mixdown(
        spark.createDataFrame(blocks, BLOCKS).repartition(5), spark.createDataFrame(rows, TRACKS), kfs,
        rate=RATE, block_size=BLOCK, master=0.7)
    want = plain(rows, blocks, keyframes if automated else [], 0.7)
    have = {(r.mix, r.frame): (r.left_value, r.right_value) for r in got.collect()}
    assert set(have) == set(want)
    for k, v in want.items():
        assert have[k] == pytest.approx(tuple(v), abs=1e-9), k


def test_silent_mix_keeps_its_length(spark):
    tracks = spark.createDataFrame([("m", 1, 1.0, 0.0, True, False)], TRACKS)
    blocks = spark.createDataFrame([("m", 1, 0, [0.5] * 6), ("m", 1, 6, [None, 0.5])], BLOCKS)
    got = M.mixdown(blocks, tracks, rate=RATE, block_size=BLOCK).orderBy("frame").collect()
    assert [tuple(r) for r in got] == [("m", f, 0.0, 0.0) for f in range(8)]
    assert M.mixdown(blocks.limit(0), tracks, rate=RATE, block_size=BLOCK).count() == 0


def test_a_block_across_borders_is_a_fault(spark):
    tracks = spark.createDataFrame([("m", 1, 1.0, 0.0, False, False)], TRACKS)
    blocks = spark.createDataFrame([("m", 1, 3, [0.5] * 6)], BLOCKS)
    with pytest.raises(Exception, match="does not lie inside its 6 frames"):
        M.mixdown(blocks, tracks, rate=RATE, block_size=BLOCK).collect()


def test_no_sample_row_is_exchanged(spark, sf):
    from timelane.plans import REGISTRY

    plan = REGISTRY["mixdown"].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    unpacked = next(i for i, line in enumerate(lines) if re.search(r"Generate posexplode", line))
    assert not any("Exchange" in line for line in lines[:unpacked])
    below = [line for line in lines[unpacked + 1:] if "Generate" in line]
    assert not any("posexplode" in line for line in below)


def test_stereo_join_with_missing_sides(spark):
    side = "pair bigint, frame bigint, value double"
    left = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.2), (1, 0, 0.3)], side)
    right = spark.createDataFrame([(0, 0, 0.5), (2, 0, 0.6)], side)
    got = {tuple(r) for r in M.stereo_join(left, right).collect()}
    assert got == {(0, 0, 0.1, 0.5), (0, 1, 0.2, 0.0), (1, 0, 0.3, 0.0), (2, 0, 0.0, 0.6)}
