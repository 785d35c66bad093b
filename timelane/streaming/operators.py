"""Streaming forms. Each takes a stream with an event time column ``ts`` (timestamp).

Every operator sets its own watermark. Rows behind that of the micro-batch before are dropped and
counted by Spark (``runner.late_rows``); rows within it may come in any order. State is per key and bounded:
rows wait no longer than the watermark's delay, and what folds, jobs and latest rows
remember goes when the watermark is past it or the key was idle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from timelane.operators.gates import level_by_time
from timelane.streaming.reorder import AT, InOrder, joined, move_timer

c = F.col
DELAY = "10 minutes"
IDLE = "1 day"


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def stream_levels(stream: DataFrame, keys, duration: str, delay: str = DELAY) -> DataFrame:
    """Peak and root mean square per closed window."""
    return level_by_time(stream.withWatermark("ts", delay), keys, duration)


def stream_debounce(stream: DataFrame, keys, quiet: str, delay: str = DELAY) -> DataFrame:
    """Last row of each burst, emitted when the watermark passes its quiet time.

    Needs ``ord`` to settle equal times.
    """
    keys = _keys(keys)
    rest = [x for x in stream.columns if x not in keys]
    best = F.max_by(F.struct(*rest), F.struct("ts", "ord")).alias("_r")
    return (
        stream.withWatermark("ts", delay)
        .groupBy(*keys, F.session_window("ts", quiet)).agg(best)
        .select(*keys, "_r.*")
    )


class _Latest(StatefulProcessor):
    """The newest row of each key, remembered until the watermark is past it: whatever comes
    later is newer."""

    def __init__(self, names):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at bigint, ord bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues):
        pdf = joined([pdf for pdf in rows if len(pdf)])
        if pdf is None:
            return
        at = np.lexsort((pdf["ord"].to_numpy(), pdf[AT].to_numpy()))[-1]
        place = (int(pdf[AT].iloc[at]), int(pdf["ord"].iloc[at]))
        held = self.newest.get()
        if held is not None and place <= tuple(held[:2]):
            return
        timer = max(-(-place[0] // 1000), timerValues.getCurrentWatermarkInMs() + 1)
        move_timer(self.handle, held[2] if held else None, timer)
        self.newest.update((*place, timer))
        yield pdf.iloc[at:at + 1][self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    """With the watermark, and the time in microseconds for processors. The time itself stays in the
    plan for Spark to find late rows; pandas sees the number only."""
    return stream.withColumn(AT, F.unix_micros("ts")).withWatermark("ts", delay)


def _run_processor(stream: DataFrame, keys, processor, schema: StructType, delay: str, mode: str) -> DataFrame:
    return _timed(stream, delay).groupBy(*_keys(keys)).transformWithStateInPandas(
        processor, schema, mode, "EventTime")


def _fields(stream: DataFrame, added: str = "") -> StructType:
    """What processors give back: all columns but ``ts``, which is ``event_us`` microseconds."""
    kept = [f for f in stream.schema.fields if f.name != "ts"]
    more = StructType.fromDDL(added).fields if added else []
    return StructType([*kept, StructField(AT, LongType()), *more])


def _with_time(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_micros(AT)).select(*columns)


def stream_latest(stream: DataFrame, keys, delay: str = DELAY) -> DataFrame:
    """The latest row per key by (``ts``, ``ord``), given whenever it changes; run it in update
    mode into a sink that replaces by key (``runner.run_upserts``).

    A key is remembered until the watermark is past its newest row, which changes nothing.
    """
    schema = _fields(stream)
    rows = _run_processor(stream, keys, _Latest(schema.names), schema, delay, "Update")
    return _with_time(rows, stream.columns)


def stream_dedupe(stream: DataFrame, keys, delay: str = DELAY) -> DataFrame:
    """First row per key; a key is forgotten behind the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(_keys(keys))


class _Fold(InOrder):
    """Runs a batch step over the rows of each key in order, carrying its state."""

    def __init__(self, step, order, idle, names):
        super().__init__(order, idle)
        self.step, self.names = step, names

    def take(self, key, memory, rows):
        memory, out = self.step(memory, rows)
        return memory, out[self.names]


def stream_fold(
    stream: DataFrame, keys, order, step, added: str = "", delay: str = DELAY, idle: str | None = IDLE
) -> DataFrame:
    """A step of ``timelane.operators.gates`` or ``history`` on a stream, as if its rows came sorted
    by ``ts`` and ``order``.

    Rows wait for the watermark, so any order within ``delay`` gives the batch result. A key
    without rows for longer than ``idle`` starts anew; None remembers it for ever. Needs the
    RocksDB state store (``timelane.session.build_session`` and the runner set it).
    """
    schema = _fields(stream, added)
    fold = _Fold(step, list(order), None if idle is None else _micros(stream, idle), schema.names)
    rows = _run_processor(stream, keys, fold, schema, delay, "Append")
    return _with_time(rows, [*stream.columns, *schema.names[len(stream.columns):]])


def _micros(stream: DataFrame, duration: str) -> int:
    """Microseconds of an interval such as ``1 day``."""
    made = stream.sparkSession.sql(f"select unix_micros(timestamp_seconds(0) + interval {duration})")
    return made.first()[0]


COALESCED = "state string, label string, edit_key string, pushed_ms bigint, first_ord bigint, merged bigint"


class _Coalesce(InOrder):
    """Keeps the open entry of each key; it leaves when the next one opens or none can join it.

    Late edits wait with the others, so which edits are neighbours is decided only for
    rows that the watermark is past.
    """

    def __init__(self, gap_ms, names):
        super().__init__(["ord"], None)
        self.gap_ms, self.names = gap_ms, names

    def _rows(self, key, entries):
        return pd.DataFrame([[*key, *e] for e in entries], columns=self.names)

    def take(self, key, entry, rows):
        done = []
        fields = ("ts_ms", "ord", "edit_key", "label", "state")
        for ts, ord_, edit_key, label, state in zip(*[rows[f].tolist() for f in fields]):
            edit_key = edit_key if isinstance(edit_key, str) else None
            same = entry is not None and edit_key is not None and entry[2] == edit_key
            if same and ts - entry[3] <= self.gap_ms:
                entry[1], entry[3], entry[5] = label, int(ts), entry[5] + 1
                continue
            if entry is not None:
                done.append(entry)
            entry = [state, label, edit_key, int(ts), int(ord_), 1]
        return entry, self._rows(key, done) if done else None

    def rest(self, key, entry, watermark):
        if entry is None or self.wakes(entry) > watermark:
            return entry, None
        return None, self._rows(key, [entry])

    def wakes(self, entry):
        return None if entry is None else (entry[3] + self.gap_ms + 1) * 1000


def stream_coalesce(stream: DataFrame, keys, gap_ms: int = 500, delay: str = DELAY) -> DataFrame:
    """Edits merged by key and adjacency, as in ``history.coalesce_edits``.

    Needs ``ts``, ``ts_ms`` (its milliseconds), ``ord``, ``edit_key``, ``label`` and a text
    ``state``. An entry leaves once the watermark is past its gap or a later edit follows.
    """
    keys = _keys(keys)
    by_key = [f for f in stream.schema.fields if f.name in keys]
    by_key.sort(key=lambda f: keys.index(f.name))
    schema = StructType(by_key + StructType.fromDDL(COALESCED).fields)
    return _run_processor(stream, keys, _Coalesce(gap_ms, schema.names), schema, delay, "Append")


class _Progress(StatefulProcessor):
    """Blocks done of all blocks of a job; one map entry per stem, running totals.

    A finished job keeps one row, without stems, until the watermark is past its last
    event, so that rows still on their way do not open it again; a job without events for ``idle``
    is given up.
    """

    def __init__(self, idle: int, names):
        self.idle, self.names = idle, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        stem = StructType([StructField("stem", StringType())])
        pair = StructType([StructField("done", LongType()), StructField("total", LongType())])
        self.stems = handle.getMapState("stems", stem, pair)
        self.sums = handle.getValueState("sums", "done bigint, total bigint, known bigint, last bigint, finished boolean, timer bigint")

    def handleInputRows(self, key, rows, timerValues):
        done, total, known, last, finished, timer = self.sums.get() or (0, 0, 0, 0, False, None)
        pdf = joined([pdf for pdf in rows if len(pdf)])
        if finished or pdf is None:
            return
        pdf = pdf.sort_values([AT, "ord"], kind="stable")
        met, held = {}, {}  # stems of these rows as they are now and as they were saved
        fields = ("stem", "blocks_done", "blocks", "stems", AT)
        for stem, now, blocks, stems, at in zip(*[pdf[f].tolist() for f in fields]):
            name, whole = (str(stem),), max(int(blocks), 1)
            if name not in met:
                held[name] = met[name] = self.stems.getValue(name)
                known += held[name] is None
            before = met[name] or (0, 0)
            after = (min(max(int(now), before[0]), whole), whole)
            done, total = done + after[0] - before[0], total + after[1] - before[1]
            met[name], last = after, max(last, int(at))
            finished = known >= int(stems) and done == total
        if finished:
            self.stems.clear()
        else:
            for name, pair in met.items():
                if held[name] is None or tuple(held[name]) != pair:
                    self.stems.updateValue(name, pair)
        wake = (last if finished else last + self.idle) // 1000
        wake = max(wake, timerValues.getCurrentWatermarkInMs()) + 1
        move_timer(self.handle, timer, wake)
        self.sums.update((done, total, known, last, finished, wake))
        yield pd.DataFrame([[*key, done, total, bool(finished), last]], columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.stems.clear()
        self.sums.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_progress(stream: DataFrame, job: str, delay: str = DELAY, idle: str = IDLE) -> DataFrame:
    """Running progress per job: ``done`` and ``total`` blocks, ``finished`` and ``last_us`` (its last
    event), given with every micro-batch that has rows of the job; run it in update mode.

    Rows: job, ``ts``, ``ord``, ``stem``, ``blocks_done`` of ``blocks``, and ``stems`` (how many
    the job has). A stem never goes back, so order does not matter. See :class:`_Progress` for
    when a job is forgotten.
    """
    field = stream.schema[job]
    results = StructType.fromDDL("done bigint, total bigint, finished boolean, last_us bigint")
    schema = StructType([field, *results.fields])
    progress = _Progress(_micros(stream, idle), schema.names)
    return _run_processor(stream, job, progress, schema, delay, "Update")
