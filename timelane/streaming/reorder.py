"""Rows of a key held back until the watermark is past them, then handed on in order.

Rows may come in any order as long as they are not behind the watermark. Those behind the watermark
up to which the micro-batch before handed rows on are dropped by Spark before any state sees
them, and counted (:func:`timelane.streaming.runner.late_rows`).
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

AT = "event_us"
"""Column with the microseconds of the event time; processors rename columns with a leading _."""
_CHUNK = StructType([StructField("rows", BinaryType())])
_TEXT = StructType([StructField("v", StringType())])


def pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(chunk: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(chunk).read_pandas()


def joined(pieces: list[pd.DataFrame]) -> pd.DataFrame | None:
    return pd.concat(pieces) if len(pieces) > 1 else pieces[0] if pieces else None


def move_timer(handle: StatefulProcessorHandle, timer: int | None, wake: int | None) -> None:
    """Set ``wake`` in place of ``timer``, the one a key has; None is none."""
    if wake == timer:
        return
    if timer is not None:
        handle.deleteTimer(timer)
    if wake is not None:
        handle.registerTimer(wake)


class InOrder(StatefulProcessor):
    """Base of processors that need a key's rows in time order.

    ``pending`` is a list of packed pieces of rows, no more than arrived within the watermark's
    delay; ``memory`` is what :meth:`take` makes of all rows handed on so far. A key without
    rows for ``idle`` microseconds of event time is forgotten: its memory goes, and a row
    that comes later starts anew, whenever the watermark got there.
    """

    def __init__(self, order: list[str], idle: int | None):
        self.order, self.idle = order, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _CHUNK)
        self.memory = handle.getValueState("memory", _TEXT)

    def take(self, key, memory, rows: pd.DataFrame):
        """(memory, output or None) after ``rows``, which follow all rows before."""
        raise NotImplementedError

    def rest(self, key, memory, watermark: int):
        """(memory, output or None) when no more rows up to ``watermark`` can come."""
        return memory, None

    def wakes(self, memory) -> int | None:
        """Microseconds of the watermark at which :meth:`rest` has something to do."""
        return None

    def handleInputRows(self, key, rows, timerValues):
        yield from self._release(key, timerValues, [pdf for pdf in rows if len(pdf)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._release(key, timerValues, fired=expiredTimerInfo.getExpiryTimeInMs())

    def _release(self, key, timerValues, new=(), fired=None):
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.memory.get()
        memory, last, timer, waits = json.loads(held[0]) if held else [None, None, None, False]
        waiting = [unpack(chunk) for (chunk,) in self.pending.get()] if waits else []
        waiting = joined([*waiting, *new])
        if waiting is not None:
            due = (waiting[AT] <= watermark).to_numpy()
            ready, waiting = (waiting[due], waiting[~due]) if due.any() else (waiting[:0], waiting)
            for run in self._runs(ready.sort_values([AT, *self.order], kind="stable"), last) if len(ready) else ():
                if last is not None and self.idle is not None and run[AT].iloc[0] - last > self.idle:
                    memory, out = self.rest(key, memory, int(run[AT].iloc[0]) - 1)
                    memory = None
                    if out is not None and len(out):
                        yield out
                memory, out = self.take(key, memory, run)
                last = int(run[AT].iloc[-1])
                if out is not None and len(out):
                    yield out
        memory, out = self.rest(key, memory, watermark)
        if out is not None and len(out):
            yield out
        self._keep(memory, last, None if timer == fired else timer, waits, waiting, watermark)

    def _runs(self, rows: pd.DataFrame, last):
        """``rows`` cut where a key was idle for too long."""
        if self.idle is None or rows.empty:
            return [rows] if len(rows) else []
        at = rows[AT].to_numpy()
        if at[0] - (at[0] if last is None else last) <= self.idle and (at[1:] - at[:-1] <= self.idle).all():
            return [rows]
        before = rows[AT].shift(fill_value=rows[AT].iloc[0] if last is None else last)
        return [run for _, run in rows.groupby((rows[AT] - before > self.idle).cumsum(), sort=True)]

    def _keep(self, memory, last, timer, waits: bool, waiting, watermark: int) -> None:
        """Write what changed. Every call of a state is a round trip to the JVM, so the timer that is
        set and whether rows wait are remembered with the memory."""
        wakes, left = [], waiting is not None and len(waiting) > 0
        if left:
            self.pending.put([(pack(waiting),)])
            wakes.append(int(waiting[AT].min()))
        elif waits:
            self.pending.clear()
        gone = last is None or self.idle is not None and watermark - last > self.idle
        if gone:
            memory, last = None, None
        else:
            if self.idle is not None:
                wakes.append(last + self.idle + 1)
            if (due := self.wakes(memory)) is not None:
                wakes.append(due)
        # Timers are in milliseconds; one that lies behind would never end.
        wake = max(-(-min(wakes) // 1000), watermark // 1000 + 1) if wakes else None
        move_timer(self.handle, timer, wake)
        if gone and not left and wake is None:
            self.memory.clear()
        else:
            self.memory.update((json.dumps([memory, last, wake, left]),))

    def close(self) -> None:
        pass
