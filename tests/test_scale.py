"""What one task gets does not grow with the table: files of a slice, rows of a scan, pieces of a window."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tests.test_reorder_calls import _Handle, _State, _Times
from timelane import session
from timelane.operators.ordered import ordered
from timelane.session import widen
from timelane.sources import containers as C
from timelane.streaming import operators as O
from timelane.streaming import runner
from timelane.streaming.reorder import AT


def test_a_slice_is_one_micro_batch_of_many_files(spark, monkeypatch):
    """Slice 1 is too small for its files, slice 2 is empty; each is still a batch of its own."""
    monkeypatch.setattr(runner, "FILE_ROWS", 100)
    slice_of = F.when(F.col("id") < 950, 0).when(F.col("id") < 953, 1).when(F.col("id") < 990, 3)
    stream = runner.dripped(spark.range(1000), slice_of, 4, "many")
    seen = {}

    def note(batch, batch_id):
        files = batch.select(F.input_file_name().alias("f")).distinct().count()
        seen[batch_id] = (sorted(r.id for r in batch.collect()), files)

    stream.writeStream.foreachBatch(note).trigger(availableNow=True).start().awaitTermination()
    got = [rows for _, (rows, _) in sorted(seen.items()) if rows]
    assert got == [list(range(950)), [950, 951, 952], list(range(953, 990))]
    assert seen[0][1] == 10


def test_a_scan_of_one_row_group_is_spread_by_its_rows(spark, tmp_path, monkeypatch):
    spark.range(200).coalesce(1).write.parquet(str(tmp_path / "one"))
    monkeypatch.setattr(session, "HEAVY_ROWS", 10, raising=False)
    wide = widen(spark.read.parquet(str(tmp_path / "one")))
    assert wide.rdd.getNumPartitions() == 20 and wide.count() == 200
    many = spark.range(0, 80, 1, 16)
    assert widen(many).rdd.getNumPartitions() == 16


def test_empty_splits_do_not_count_as_spread(spark):
    one = spark.range(0, 160, 1, 16).where("id < 10")
    assert one.rdd.getNumPartitions() == 16
    sizes = widen(one).groupBy(F.spark_partition_id()).count().count()
    assert sizes > 1


def test_a_window_is_cut_far_below_the_rows_a_fold_streams(spark):
    rows = spark.range(600_000).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    data = ordered(rows, "k", ["at"])
    assert data.split
    got = data.scan(lag={"p": F.col("at")}, number="n").df
    assert got.where("(p is null and at > 0) or p <> at - 1 or n <> at + 1").count() == 0


def test_samples_come_in_pieces_of_bounded_bytes(monkeypatch):
    monkeypatch.setattr(C, "PCM_BYTES", 4, raising=False)
    data = pa.array([b"\x00\x40\x01", None, b"", b"\x40\x00\x00\x80", b"\x00\x40"])
    little = pa.array([True, True, False, False, None])
    out = list(C.pcm16_samples.func(iter([(data, little)])))
    assert len(out) > 1
    assert [x for piece in out for x in piece.to_pylist()] == [[0.5], None, [], [0.5, 128 / 32768], [64 / 32768]]


class _Stems(_State):
    def __init__(self, handle):
        super().__init__(handle)
        self.value = {}

    def containsKey(self, key):
        return self._count(key in self.value)

    def getValue(self, key):
        return self._count(self.value.get(key))

    def updateValue(self, key, pair):
        self.value[key] = self._count(pair)

    def clear(self):
        self.value = self._count({})


class _Jobs(_Handle):
    def getMapState(self, name, key, value):
        return _Stems(self)


def test_a_job_calls_its_state_once_a_stem():
    job, handle = O._Progress(10**9, ["job", "done", "total", "finished", "last_us"]), _Jobs()
    job.init(handle)
    n = 40
    rows = pd.DataFrame({
        AT: range(1000, 1000 + n), "ord": range(n), "stem": ["a", "b"] * (n // 2),
        "blocks_done": [1 + i // 2 for i in range(n)], "blocks": [30] * n, "stems": [2] * n})
    out = pd.concat(list(job.handleInputRows((7,), iter([rows]), _Times(0))))
    assert out.values.tolist() == [[7, 40, 60, False, 1000 + n - 1]]
    assert handle.calls <= 7 and len(handle.timers) == 1
    handle.calls = 0
    rest = rows.assign(blocks_done=[11 + i // 2 for i in range(n)], **{AT: range(5000, 5000 + n)})
    out = pd.concat(list(job.handleInputRows((7,), iter([rest]), _Times(0))))
    assert out.values.tolist() == [[7, 60, 60, True, 5000 + n - 1]]
    assert handle.calls <= 7 and handle.timers == {5 + 1}
    assert list(job.handleInputRows((7,), iter([rows]), _Times(0))) == []


def test_the_latest_row_calls_its_state_few_times():
    latest, handle = O._Latest(["series", "ord", AT]), _Handle()
    latest.init(handle)
    rows = pd.DataFrame({"series": [1, 1, 1], "ord": [3, 5, 4], AT: [9000, 9000, 2000]})
    out = pd.concat(list(latest.handleInputRows((1,), iter([rows]), _Times(0))))
    assert out["ord"].tolist() == [5] and handle.calls <= 3 and handle.timers == {9}
    handle.calls = 0
    assert list(latest.handleInputRows((1,), iter([rows]), _Times(0))) == [] and handle.calls <= 1
    handle.calls = 0
    newer = rows.assign(**{AT: [12000, 11000, 10000]})
    out = pd.concat(list(latest.handleInputRows((1,), iter([newer]), _Times(0))))
    assert out["ord"].tolist() == [3] and handle.calls <= 4 and handle.timers == {12}
