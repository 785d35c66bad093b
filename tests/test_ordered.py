import random

import pytest
from pyspark.sql import functions as F

from timelane.operators.ordered import collect_parts, ordered


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(600):
        key = "hot" if i % 3 else rng.choice(["a", "b", None])
        out.append((key, rng.randint(0, 50), i, rng.choice([None, 1.0, 2.5, -3.0])))
    return out


def expected(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    out = set()
    for key, g in groups.items():
        total, best, seen = 0.0, None, None
        for i, (_, t, n, v) in enumerate(g):
            before = total
            total += v or 0.0
            best = v if best is None else best if v is None else max(best, v)
            seen = v if v is not None else seen
            prev = g[i - 1][3] if i else None
            nxt = g[i + 1][3] if i + 1 < len(g) else None
            out.add((key, t, n, v, prev, nxt, before, total, best, seen, i + 1))
    return out


@pytest.mark.parametrize("limit", [10**9, 100, 7])
def test_scan_equals_sequential(spark, rows, limit):
    df = spark.createDataFrame(rows, "k string, t int, n int, v double").repartition(5)
    v = F.col("v")
    o = ordered(df, "k", ["t", "n"], rows_per_chunk=limit)
    assert o.split == (limit < 400)
    got = o.scan(
        lag={"prev": v}, lead={"next": v}, before={"b": v}, upto={"u": v},
        peak={"p": v}, fill={"f": v}, number="i",
    ).df
    names = ["k", "t", "n", "v", "prev", "next", "b", "u", "p", "f", "i"]
    assert {tuple(r) for r in got.select(*names).collect()} == expected(rows)


def test_hot_key_is_spread(spark, rows):
    df = spark.createDataFrame(rows, "k string, t int, n int, v double")
    o = ordered(df, "k", ["t", "n"], rows_per_chunk=50)
    sizes = o.frame.where("_chunk > 0").groupBy("k", "_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100


def test_collect_parts_keeps_everything(spark):
    df = spark.range(25).select(F.lit(1).alias("k"), "id")
    got = collect_parts(df, "k", "id", F.col("id"), "ids", size=10).orderBy("part").collect()
    assert [r["ids"] for r in got] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
