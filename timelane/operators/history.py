"""Edit logs: coalescing, retention, undo and redo, transport position."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timelane.operators.fold import fold_by_key
from timelane.operators.ordered import biggest, mark_runs, ordered

c = F.col
COALESCE_MS = 500
MAX_ENTRIES = 100


def coalesce_edits(log: DataFrame, keys, gap_ms: int = COALESCE_MS) -> DataFrame:
    """Merge a push into the previous one of the same non-null ``edit_key`` within the gap.

    ``log``: keys, ts_ms, ord, edit_key, label, state. A merged entry keeps the first state
    and takes the last label and time. Exact for logs of pushes only.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    data = ordered(log, keys, ["ts_ms", "ord"]).scan(
        lag={"_key": c("edit_key"), "_ts": c("ts_ms")}
    )
    same = (c("edit_key") == c("_key")) & (c("ts_ms") - c("_ts") <= gap_ms)
    runs = mark_runs(data, ~F.coalesce(same, F.lit(False)), "_run").df
    at = F.struct("ts_ms", "ord")
    return runs.groupBy(*keys, "_run").agg(
        F.min_by("state", at).alias("state"), F.max_by("label", at).alias("label"),
        F.min_by("edit_key", at).alias("edit_key"), F.max("ts_ms").alias("pushed_ms"),
        F.min_by("ord", at).alias("first_ord"), F.count(F.lit(1)).alias("merged"),
    ).drop("_run")


def cap_history(entries: DataFrame, keys, order=("pushed_ms", "first_ord"), keep=MAX_ENTRIES):
    """The newest entries of each key. Spark cuts every map partition to ``keep`` rows a
    key before the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = W.partitionBy(*keys).orderBy(*[F.desc(x) for x in order])
    return entries.withColumn("_n", F.row_number().over(w)).where(c("_n") <= keep).drop("_n")


def last_transport(states: DataFrame, probes: DataFrame, keys, at: str = "at") -> DataFrame:
    """Playhead at each probe from the latest state before it.

    ``states``: keys, at, ord, playing, offset. Null without an earlier state.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    s = states.select(
        *keys, c(at).alias("_t"), F.lit(0).alias("_kind"), c("ord").alias("_ord"),
        F.struct("playing", "offset", c(at).alias("started")).alias("_state"),
    )
    p = probes.select(
        *keys, c(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_ord"),
        F.struct(*[c(x) for x in probes.columns]).alias("_row"),
    )
    both = s.unionByName(p, allowMissingColumns=True)
    bound = biggest(states, keys) + biggest(probes, keys)
    found = ordered(both, keys, ["_t", "_kind", "_ord"], bound=bound).scan(fill={"_s": c("_state")}).df
    x = c("_s")
    moving = F.greatest(F.lit(0.0), x["offset"] + (c("_t") - x["started"]))
    return found.where(c("_kind") == 1).select(
        "_row.*", F.when(x["playing"], moving).otherwise(x["offset"]).alias("position")
    )


UNDO_OUTPUT = "past bigint, future bigint, restored string"


def undo_step(state, rows: pd.DataFrame):
    """Run push, undo, redo and clear over two stacks.

    A stack entry is [state, label, edit_key, pushed_ms]. Each row yields the stack sizes
    after it and, for undo and redo, the state to restore.
    """
    past, future = ([list(e) for e in s] for s in (state or ([], [])))
    sizes, ahead, restored = [], [], []
    fields = zip(rows["op"], rows["ts_ms"], rows["edit_key"], rows["label"], rows["state"])
    for op, ts, key, label, value in fields:
        key = key if isinstance(key, str) else None
        ts, back = int(ts), None
        if op == "push":
            tail = past[-1] if past else None
            if tail and key is not None and tail[2] == key and ts - tail[3] <= COALESCE_MS:
                tail[1], tail[3] = label, ts
            else:
                past.append([value, label, key, ts])
                del past[:-MAX_ENTRIES]
            future.clear()
        elif op in ("undo", "redo"):
            source, target = (past, future) if op == "undo" else (future, past)
            if source:
                entry = source.pop()
                target.append([value, entry[1], entry[2], ts])
                back = entry[0]
        elif op == "clear":
            past.clear()
            future.clear()
        sizes.append(len(past))
        ahead.append(len(future))
        restored.append(back)
    out = rows.assign(past=sizes, future=ahead, restored=restored)
    return [past, future], out


def undo_redo(log: DataFrame, keys, rows_per_chunk: int | None = None) -> DataFrame:
    """Stack machine per key over ``op``, ``ts_ms``, ``ord``, ``edit_key``, ``label``,
    ``state``; undo and redo rows carry the current state."""
    return fold_by_key(
        log, keys, ["ts_ms", "ord"], undo_step, UNDO_OUTPUT, rows_per_chunk=rows_per_chunk
    )
