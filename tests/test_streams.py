"""Streams whose rows come out of order against the batch forms, and what they remember."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_folds import FRAME, LOG, by_key, coalesced, frames, push_log
from timelane.operators import gates as G
from timelane.streaming import operators as O
from timelane.streaming.retention import read_retained, retention_writer
from timelane.streaming.runner import late_rows

c = F.col


def drip(spark, tmp_path, slices, schema):
    """A file stream that reads one of ``slices`` a batch, in order, with ``ts`` from ``ts_ms``."""
    folder = tmp_path / "in"
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return stream.withColumn("ts", F.timestamp_millis("ts_ms"))


def sliced(rows, delay_ms, slices, at=2):
    """Cut by time, each row up to ``delay_ms`` late, and shuffled inside a slice."""
    rng = random.Random(11)
    moved = sorted(rows, key=lambda r: r[at] + rng.randint(0, delay_ms))
    step = -(-len(rows) // slices)
    out = [moved[i:i + step] for i in range(0, len(rows), step)]
    for part in out:
        rng.shuffle(part)
    return out


def collected(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name).collect(), q


@pytest.fixture(scope="module")
def held_back(spark, tmp_path_factory):
    rows = frames(300, 21)
    far = max(r[2] for r in rows) + 600_000
    ends = [(s, 10**6 + i, far, far / 1000, 0.0) for i, s in enumerate(("hot", "a", "b"))]
    return rows, [*sliced(rows, 20_000, 4), ends], far


def test_folds_of_shuffled_rows_equal_batch(spark, tmp_path, held_back):
    """Nothing is lost within the watermark; the last rows only push it forward."""
    rows, slices, far = held_back
    stream = drip(spark, tmp_path, slices, FRAME)
    held = O.stream_fold(stream, "series", ["ord"], G.peak_hold_step(), "hold double", "30 seconds", None)
    got, q = collected(held, "held")
    want = by_key(rows, G.peak_hold_step())
    assert {(r.series, r.ord, r.hold) for r in got if r.ts_ms < far} == set(zip(want.series, want.ord, want.hold))
    assert late_rows(q) == 0


@pytest.mark.parametrize("step,name", [(G.throttle_step(), "throttled"), (G.delta_step(0.3), "moved")])
def test_gates_of_shuffled_rows_equal_batch(spark, tmp_path, held_back, step, name):
    rows, slices, far = held_back
    stream = drip(spark, tmp_path, slices, FRAME).withColumn("position", c("peak"))
    got, _ = collected(O.stream_fold(stream, "series", ["ord"], step, delay="30 seconds", idle=None), name)
    want = by_key(rows, step)
    assert {(r.series, r.ord) for r in got if r.ts_ms < far} == set(zip(want.series, want.ord))


def test_late_rows_are_counted_and_idle_keys_start_anew(spark, tmp_path):
    one = [("s", i, 1000 * i + 500, float(i), 0.9) for i in range(5)]
    two = [("s", 5, 200_000, 200.0, 0.1), ("t", 6, 200_000, 200.0, 0.5)]
    three = [("s", 7, 3_000, 3.0, 0.8), ("s", 8, 400_000, 400.0, 0.2), ("t", 9, 800_000, 800.0, 0.1)]
    late = [("s", 10, 189_000, 189.0, 0.3), ("t", 11, 900_000, 900.0, 0.1)]
    stream = drip(spark, tmp_path, [one, two, three, late], FRAME)
    step = G.throttle_step(10**9)  # passes the first row of a life only
    got, q = collected(O.stream_fold(stream, "series", ["ord"], step, delay="10 seconds", idle="100 seconds"), "lives")
    # 7 still finds its place, 10 comes behind the watermark of the batch before
    assert sorted((r.series, r.ord) for r in got) == [("s", 0), ("s", 5), ("s", 8), ("t", 6), ("t", 9)]
    assert late_rows(q) == 1
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # s is forgotten, t has a row waiting


def test_coalesce_of_shuffled_edits_equals_batch(spark, tmp_path):
    rows = push_log(200, 8)
    far = max(r[1] for r in rows) + 10_000_000
    ends = [(m, far, 10_000 + m, None, "end", "end") for m in range(3)]
    stream = drip(spark, tmp_path, [*sliced(rows, 3_000, 4, at=1), ends], LOG)
    got, q = collected(O.stream_coalesce(stream, "mix", delay="5 seconds"), "merged")
    got = sorted(((r.mix, r.state, r.label, r.edit_key, r.pushed_ms, r.first_ord, r.merged)
                  for r in got if r.state != "end"), key=lambda r: (r[0], r[5]))
    assert got == coalesced(rows) and late_rows(q) == 0


PROGRESS = "job string, ts_ms bigint, ord bigint, stem string, blocks_done bigint, blocks bigint, stems int"


def test_progress_forgets_finished_jobs(spark, tmp_path):
    slices = [
        [("j", 2_000, 1, "b", 0, 0, 2), ("j", 1_000, 0, "a", 1, 4, 2), ("k", 4_000, 3, "a", 2, 3, 2)],
        [("j", 3_000, 2, "a", 4, 4, 2), ("j", 5_000, 4, "b", 1, 0, 2)],
        [("j", 4_500, 6, "a", 3, 4, 2), ("k", 6_000, 5, "a", 1, 3, 2)],
        [("x", 100_000, 7, "a", 1, 2, 1)], [("x", 101_000, 8, "a", 1, 2, 1)],
    ]
    stream = drip(spark, tmp_path, slices, PROGRESS)
    got, q = collected(O.stream_progress(stream, "job", "10 seconds", "50 seconds"), "progress", "update")
    assert [(r.done, r.total, r.finished) for r in got if r.job == "j"][-1] == (5, 5, True)
    assert len([r for r in got if r.job == "j"]) == 2  # the row after the end changes nothing
    assert [(r.done, r.total, r.finished) for r in got if r.job == "k"][-1] == (2, 3, False)
    # j ended and k was idle for 50 seconds: x alone is left, one row of sums and one stem
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_latest_is_bounded(spark, tmp_path):
    schema = "key string, ts_ms bigint, ord bigint, v int"
    slices = [[("a", 1_000, 0, 1), ("b", 2_000, 1, 2), ("a", 900, 2, 3)], [("a", 1_500, 3, 4), ("b", 1_999, 4, 5)],
              [("c", 90_000, 5, 6)], [("c", 90_001, 6, 7), ("a", 95_000, 7, 8)]]
    got, q = collected(O.stream_latest(drip(spark, tmp_path, slices, schema), "key", "20 seconds"), "latest", "update")
    assert [(r.key, r.v) for r in got if r.key == "a"] == [("a", 1), ("a", 4), ("a", 8)]
    assert [r.v for r in got if r.key == "b"] == [2]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_dedupe_within_watermark(spark, tmp_path):
    schema = "id string, ts_ms bigint"
    slices = [[("a", 1_000), ("b", 2_000)], [("a", 3_000), ("c", 4_000)], [("b", 5_000)]]
    got, _ = collected(O.stream_dedupe(drip(spark, tmp_path, slices, schema), "id"), "once")
    assert sorted((r.id, r.ts_ms) for r in got) == [("a", 1_000), ("b", 2_000), ("c", 4_000)]


# Retention

KEPT = "id string, owner string, created bigint"


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_retention_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "kept")
    write = retention_writer(path, "id", "owner", "created", "id", keep=2, buckets=16)
    owners = [f"o{i}" for i in range(40)]
    first = spark.createDataFrame([(f"{o}-{n}", o, n) for o in owners for n in range(3)], KEPT)
    write(first, 0)
    before = files_of(path + "/data")
    put = spark.createDataFrame([("o3-9", "o3", 9), ("o3-1", "o3", 11)], KEPT)
    write(put, 1)
    after = files_of(path + "/data")
    assert before <= after and len(after - before) == 1  # one bucket written, the others untouched
    rows = {(r.owner, r.id, r.created) for r in read_retained(spark, path, KEPT).collect()}
    assert {r for r in rows if r[0] == "o3"} == {("o3", "o3-9", 9), ("o3", "o3-1", 11)}
    assert len(rows) == 80
    write(put, 1)  # a batch that runs again
    assert {(r.owner, r.id, r.created) for r in read_retained(spark, path, KEPT).collect()} == rows
    write(spark.createDataFrame([("o5-9", "o5", 9)], KEPT), 2)
    assert len(before - files_of(path + "/data")) == 1  # what batch 1 replaced has gone
    assert {r.id for r in read_retained(spark, path, KEPT).where("owner = 'o5'").collect()} == {"o5-9", "o5-2"}
    write(spark.createDataFrame([], KEPT), 3)
    assert read_retained(spark, path, KEPT).count() == 80


def test_a_batch_that_broke_off_is_as_if_not_begun(spark, tmp_path):
    path = str(tmp_path / "kept")
    write = retention_writer(path, "id", "owner", "created", "id", keep=1, buckets=4)
    write(spark.createDataFrame([("a", "o", 1)], KEPT), 0)
    spark.createDataFrame([("b", "o", 5, 0)], KEPT + ", bucket int").write.partitionBy("bucket").parquet(f"{path}/data/version=1")
    assert [r.id for r in read_retained(spark, path, KEPT).collect()] == ["a"]
    write(spark.createDataFrame([("c", "o", 3)], KEPT), 1)
    assert [r.id for r in read_retained(spark, path, KEPT).collect()] == ["c"]
    assert read_retained(spark, str(tmp_path / "none"), KEPT).count() == 0
