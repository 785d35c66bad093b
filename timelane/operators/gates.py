"""Sequential meters and gates: one step function each, for batch and for streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelane.operators.fold import fold_by_key
from timelane.operators.ordered import ordered

c = F.col
HOLD_SECONDS = 1.0
PAIR_HOLD_SECONDS = 0.5
DECAY_PER_SECOND = 0.6
THROTTLE_MS = 80
MIN_DELTA = 0.008
QUIET_MS = 200


def peak_hold_step(hold_seconds: float = HOLD_SECONDS, decay: float = DECAY_PER_SECOND):
    """Held peak per frame; needs ``at`` (seconds) and ``peak``.

    A peak at or above the hold replaces it and arms it again. Once the hold has run out
    the whole frame's time is taken off, never below the frame's own peak.
    """

    def step(state, rows: pd.DataFrame):
        hold, expires, last = state or (0.0, 0.0, None)
        held = []
        for now, peak in zip(rows["at"].tolist(), rows["peak"].tolist()):
            elapsed = 0.0 if last is None else now - last
            last = now
            if peak >= hold:
                hold, expires = peak, now + hold_seconds
            elif now > expires:
                hold = max(peak, hold - decay * elapsed)
            held.append(hold)
        return [hold, expires, last], rows.assign(hold=held)

    return step


def throttle_step(gap_ms: int = THROTTLE_MS):
    """Rows at least ``gap_ms`` after the last passed one, or ``forced``; needs ``ts_ms``."""

    def step(state, rows: pd.DataFrame):
        times = rows["ts_ms"].to_numpy()
        forced = rows["forced"].to_numpy(bool) if "forced" in rows else np.zeros(len(rows), bool)
        musts = [*np.flatnonzero(forced).tolist(), len(rows)]
        keep, last, must = np.zeros(len(rows), bool), state, 0
        # From one passed row to the next: the first one late enough, or a forced one before it.
        at = 0 if last is None else int(np.searchsorted(times, last + gap_ms))
        while (at := min(at, musts[must])) < len(rows):
            keep[at], last = True, times[at].item()
            must += at == musts[must]
            at = max(at + 1, int(np.searchsorted(times, last + gap_ms)))
        return last, rows[keep]

    return step


def delta_step(least: float = MIN_DELTA):
    """Rows whose ``position`` differs from the last emitted one by at least ``least``."""

    def step(state, rows: pd.DataFrame):
        last, keep = state, []
        for p in rows["position"].tolist():
            emitted = last is None or abs(p - last) >= least
            if emitted:
                last = p
            keep.append(emitted)
        return last, rows[pd.Series(keep, index=rows.index, dtype=bool)]

    return step


def peak_hold(frames: DataFrame, keys, order, rows_per_chunk=None, **settings) -> DataFrame:
    step = peak_hold_step(**settings)
    return fold_by_key(frames, keys, order, step, "hold double", rows_per_chunk)


def throttle(rows: DataFrame, keys, order, gap_ms=THROTTLE_MS, rows_per_chunk=None) -> DataFrame:
    return fold_by_key(rows, keys, order, throttle_step(gap_ms), "", rows_per_chunk)


def delta_filter(rows: DataFrame, keys, order, least=MIN_DELTA, rows_per_chunk=None) -> DataFrame:
    return fold_by_key(rows, keys, order, delta_step(least), "", rows_per_chunk)


def debounce(rows: DataFrame, keys, quiet_ms: int = QUIET_MS) -> DataFrame:
    """The last row of every burst; a row within ``quiet_ms`` of the one before joins it.

    Needs ``ts_ms`` and ``ord``. A row is the last of its burst when the next one is far,
    so looking ahead by one row is enough.
    """
    data = ordered(rows, keys, ["ts_ms", "ord"]).scan(lead={"_next": c("ts_ms")})
    last = c("_next").isNull() | (c("_next") - c("ts_ms") > quiet_ms)
    return data.map(lambda d: d.where(last).drop("_next")).df


def level_by_time(rows: DataFrame, keys, duration: str) -> DataFrame:
    """Peak and root mean square per time window; needs ``ts`` and ``value``. The same
    plan runs on a stream with a watermark on ``ts``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (
        rows.groupBy(*keys, F.window("ts", duration).alias("_w"))
        .agg(
            F.max(F.abs("value")).alias("peak"),
            F.sqrt(F.sum(c("value") * c("value")) / F.count(F.lit(1))).alias("rms"),
            F.count(F.lit(1)).alias("frames"),
        )
        .select(*keys, c("_w.start").alias("start"), c("_w.end").alias("end"), "peak", "rms",
                "frames")
    )
