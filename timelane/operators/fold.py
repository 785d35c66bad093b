"""Sequential folds per key, for results that no window expression gives.

Keys that fit a task are streamed through it in order. A larger key is cut along its order and the
pieces run in parallel: every piece first assumes the state its predecessor ended with in
the round before, and only the pieces whose assumption was wrong run again, with no rows but
theirs moved. When a round
changes nothing, every piece started from its true state, so the result is that of the
plain fold. Folds that forget (holds, gates, capped stacks) settle in about two rounds;
a fold that never forgets needs as many rounds as there are pieces and stays exact.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timelane.operators.ordered import CHUNK, split_hot_keys
from timelane.session import ensure_checkpoint_dir

c = F.col
Step = Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]]


def fold_by_key(
    df: DataFrame, keys, order, step: Step, added: str, rows_per_chunk: int | None = None
) -> DataFrame:
    """``df`` with the columns ``added`` that ``step`` computes in order.

    ``step(state, rows)`` gets the state so far (None at the start of a key) and a sorted
    frame; it returns the new state, which JSON can hold, and the frame with the added
    columns. It may drop rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = list(order)
    schema = StructType(
        df.schema.fields + StructType.fromDDL(added).fields
    )
    names = schema.names

    chunked = split_hot_keys(df, keys, order, rows_per_chunk)
    if chunked is None:
        # Sorted partitions are streamed batch by batch: a task holds one Arrow batch, and
        # many small keys share one.
        placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
        return placed.mapInPandas(_along(keys, step, names), schema)

    entries = _entry_states(chunked, keys, order, step)

    def piece(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=names)
        state = json.loads(entry["_entry"].iloc[0]) if len(entry) else None
        rows = pdf.sort_values(order, kind="stable").drop(columns=CHUNK)
        return step(state, rows)[1][names]

    return _beside(chunked, entries, [*keys, CHUNK]).applyInPandas(piece, schema)


def _along(keys, step: Step, names):
    """Fold over batches sorted by key; the state survives from batch to batch."""

    def run(batches):
        last, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            cols = [pdf[k] for k in keys]
            opens = np.zeros(len(pdf), dtype=bool)
            for col in cols:
                before = col.shift()
                opens |= ((col != before) & ~(col.isna() & before.isna())).to_numpy()
            opens[0] = True
            at = [*np.flatnonzero(opens), len(pdf)]
            out = []
            for begin, end in zip(at[:-1], at[1:]):
                key = tuple(None if pd.isna(v) else v for v in (col.iloc[begin] for col in cols))
                if key != last:
                    last, state = key, None
                state, rows = step(state, pdf.iloc[begin:end])
                out.append(rows)
            yield pd.concat(out)[names]

    return run


def _beside(rows: DataFrame, states: DataFrame, by):
    """Rows and states of each piece together; the states come from the same rows, so
    their columns are renamed to keep the two sides apart."""
    named = states.select(*[c(n).alias(f"_p_{n}") for n in by], "_entry")
    return rows.groupBy(*by).cogroup(named.groupBy(*[f"_p_{n}" for n in by]))


def _rows_of(rows: DataFrame, pieces: DataFrame, by) -> DataFrame:
    """The rows of ``pieces``, picked where they lie: there are at most about 40,000 pieces, so
    their keys are broadcast and no other row is exchanged."""
    named = F.broadcast(pieces.select(*[c(n).alias(f"_q_{n}") for n in by]))
    same = [c(n).eqNullSafe(c(f"_q_{n}")) for n in by]
    return rows.join(named, reduce(lambda a, b: a & b, same), "left_semi")


def _entry_states(chunked: DataFrame, keys, order, step) -> DataFrame:
    """The state each piece of a large key starts from."""
    ensure_checkpoint_dir(chunked.sparkSession)
    by = [*keys, CHUNK]
    hot = chunked.where(c(CHUNK) > 0)
    key_fields = [f for f in chunked.schema.fields if f.name in by]
    key_fields.sort(key=lambda f: by.index(f.name))
    states = StructType(
        [*key_fields, *StructType.fromDDL("_entry string, _exit string").fields]
    )

    def run(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or entry.empty:
            return pd.DataFrame(columns=states.names)
        text = entry["_entry"].iloc[0]
        rows = pdf.sort_values(order, kind="stable").drop(columns=CHUNK)
        state, _ = step(json.loads(text), rows)
        first = {k: [pdf[k].iloc[0]] for k in by}
        return pd.DataFrame({**first, "_entry": [text], "_exit": [json.dumps(state)]})

    def ends(wanted: DataFrame) -> DataFrame:
        return _beside(_rows_of(hot, wanted, by), wanted, by).applyInPandas(run, states)

    pieces = hot.select(*by).distinct().withColumn("_entry", F.lit("null"))
    known = ends(pieces).checkpoint()
    w = W.partitionBy(*keys).orderBy(CHUNK)
    while True:
        due = known.withColumn("_due", F.coalesce(F.lag("_exit").over(w), F.lit("null")))
        wrong = due.where(c("_due") != c("_entry")).select(*by, c("_due").alias("_entry"))
        wrong = wrong.checkpoint()
        if wrong.isEmpty():
            return known.select(*by, "_entry")
        fixed = ends(wrong)
        redone = wrong.select(*[c(n).alias(f"_p_{n}") for n in by])
        same = [c(n).eqNullSafe(c(f"_p_{n}")) for n in by]
        kept = known.join(redone, reduce(lambda a, b: a & b, same), "left_anti")
        known = kept.unionByName(fixed).checkpoint()

