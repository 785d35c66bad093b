"""Running computations inside a key, safe when one key holds a large part of the rows.

A plain window puts all rows of a key into one task. ``ordered`` first counts the
rows per key (a map-side combined aggregate over the key columns only). While every
key fits a task the plain window is used: one shuffle, nothing else. Keys above the
limit are cut into ranges of the order columns; each range is a window partition of
its own, one summary row per range carries the running values across the cuts.

The order columns must be a total order inside a key. Ascending, nulls first.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timelane.session import WINDOW_ROWS_DEFAULT, hot_rows

CHUNK = "_chunk"
# At most about twice this many ranges exist whatever the data size, so the split
# points and the summaries (one row per range) may be broadcast.
MAX_CHUNKS = 20_000
SAMPLES_PER_CHUNK = 64


@dataclass(frozen=True)
class Ordered:
    frame: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool
    top: int | None = None  # no key holds more rows than this

    @property
    def df(self) -> DataFrame:
        return self.frame.drop(CHUNK)

    def map(self, fn) -> "Ordered":
        """Apply a row-wise transformation and keep the partitioning."""
        return replace(self, frame=fn(self.frame))

    def window(self) -> W:
        keys = [*self.keys, CHUNK] if self.split else list(self.keys)
        return W.partitionBy(*keys).orderBy(*self.order)

    def scan(
        self,
        *,
        lag: dict[str, Column] | None = None,
        lead: dict[str, Column] | None = None,
        before: dict[str, Column] | None = None,
        upto: dict[str, Column] | None = None,
        peak: dict[str, Column] | None = None,
        fill: dict[str, Column] | None = None,
        number: str | None = None,
    ) -> "Ordered":
        """Add columns.

        ``lag``/``lead``: value of the neighbour row. ``before``/``upto``: running sum
        without/with the row. ``peak``: running maximum. ``fill``: last value that is
        not null. ``number``: position from 1.
        """
        lag, lead, before = lag or {}, lead or {}, before or {}
        upto, peak, fill = upto or {}, peak or {}, fill or {}
        w = self.window()
        run = w.rowsBetween(W.unboundedPreceding, 0)
        past = w.rowsBetween(W.unboundedPreceding, -1)
        local = {n: F.lag(c).over(w) for n, c in lag.items()}
        local |= {n: F.lead(c).over(w) for n, c in lead.items()}
        local |= {n: F.coalesce(F.sum(c).over(past), F.lit(0)) for n, c in before.items()}
        local |= {n: F.coalesce(F.sum(c).over(run), F.lit(0)) for n, c in upto.items()}
        local |= {n: F.max(c).over(run) for n, c in peak.items()}
        local |= {n: F.last(c, ignorenulls=True).over(run) for n, c in fill.items()}
        if number:
            local[number] = F.row_number().over(w).cast("bigint")
        if not self.split:
            return replace(self, frame=_with(self.frame, local))

        point = F.struct(*self.order)
        sums = {**before, **upto}
        parts = {n: F.max_by(F.struct(c.alias("v")), point) for n, c in lag.items()}
        parts |= {n: F.min_by(F.struct(c.alias("v")), point) for n, c in lead.items()}
        parts |= {n: F.sum(c) for n, c in sums.items()}
        parts |= {n: F.max(c) for n, c in peak.items()}
        parts |= {
            n: F.max_by(
                F.when(c.isNotNull(), F.struct(c.alias("v"))), F.when(c.isNotNull(), point)
            )
            for n, c in fill.items()
        }
        if number:
            parts[number] = F.count(F.lit(1))
        summary = (
            self.frame.where(F.col(CHUNK) > 0)
            .groupBy(*self.keys, CHUNK)
            .agg(*[c.alias(f"_s_{n}") for n, c in parts.items()])
        )
        cw = W.partitionBy(*self.keys).orderBy(CHUNK)
        cpast = cw.rowsBetween(W.unboundedPreceding, -1)
        carry = {n: F.lag(f"_s_{n}").over(cw) for n in lag}
        carry |= {n: F.lead(f"_s_{n}").over(cw) for n in lead}
        carry |= {n: F.sum(f"_s_{n}").over(cpast) for n in (*sums, *([number] if number else ()))}
        carry |= {n: F.max(f"_s_{n}").over(cpast) for n in peak}
        carry |= {n: F.last(f"_s_{n}", ignorenulls=True).over(cpast) for n in fill}
        carried = summary.select(
            *[F.col(k).alias(f"_k_{k}") for k in (*self.keys, CHUNK)],
            *[c.alias(f"_c_{n}") for n, c in carry.items()],
        )
        local["_first"] = F.row_number().over(w) == 1
        local["_final"] = F.lead(F.lit(1)).over(w).isNull()
        joined = _with(self.frame, local).join(
            F.broadcast(carried), _same([*self.keys, CHUNK], "_k_"), "left"
        )

        def c(n):
            return F.col(f"_c_{n}")

        whole = {n: F.when(F.col("_first"), c(n)["v"]).otherwise(F.col(n)) for n in lag}
        whole |= {n: F.when(F.col("_final"), c(n)["v"]).otherwise(F.col(n)) for n in lead}
        whole |= {n: F.col(n) + F.coalesce(c(n), F.lit(0)) for n, v in sums.items()}
        whole |= {n: F.greatest(F.col(n), c(n)) for n in peak}
        whole |= {n: F.coalesce(F.col(n), c(n)["v"]) for n in fill}
        if number:
            whole[number] = F.col(number) + F.coalesce(c(number), F.lit(0))
        kept = [x for x in self.frame.columns if x not in whole]
        out = joined.select(*kept, *[v.alias(n) for n, v in whole.items()])
        return replace(self, frame=out)


def ordered(
    df: DataFrame | Ordered, keys, order, rows_per_chunk: int | None = None,
    bound: int | None = None,
) -> Ordered:
    """Prepare ``df`` for running computations per ``keys`` in the order of ``order``.

    A window buffers the rows of its partition, so a key is cut from ``WINDOW_ROWS_DEFAULT`` rows on.
    The rows per key are counted once, here. ``bound`` is a known upper limit of them: when
    it fits a task nothing is counted. An ``Ordered`` of the same keys is taken as it is.
    """
    keys, order = _names(keys), _names(order)
    if isinstance(df, Ordered):
        if df.keys != keys:
            raise ValueError(f"rows are ordered per {df.keys}, not {keys}")
        return df
    limit = rows_per_chunk or hot_rows(df.sparkSession, WINDOW_ROWS_DEFAULT)
    if bound is not None and bound <= limit:
        return Ordered(df, keys, order, False, bound)
    total, top = _row_counts(df, keys)
    chunked = _split(df, keys, order, limit, total, top)
    if chunked is None:
        return Ordered(df, keys, order, False, top)
    return Ordered(chunked, keys, order, True, top)


def biggest(df: DataFrame | Ordered, keys) -> int:
    """Rows of the largest key."""
    if isinstance(df, Ordered) and df.top is not None:
        return df.top
    return _row_counts(df, _names(keys))[1]


def _row_counts(df: DataFrame, keys) -> tuple[int, int]:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total, top = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    return total or 0, top or 0


def split_hot_keys(df: DataFrame, keys, order, rows_per_chunk: int | None = None):
    """``df`` with a ``_chunk`` column: 0 for keys that fit a task, else 1, 2, ... along
    the order. ``None`` when every key fits."""
    limit = rows_per_chunk or hot_rows(df.sparkSession)
    return _split(df, keys, order, limit, *_row_counts(df, keys))


def _split(df: DataFrame, keys, order, limit: int, total: int, top: int):
    limit = max(limit, total // MAX_CHUNKS)
    if top <= limit:
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.where(F.col("_rows") > limit).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys]
    )
    every = max(1, limit // SAMPLES_PER_CHUNK)
    stride = max(1, limit // every)
    # A hash of the row decides what is sampled, so a retried task samples the same rows.
    sample = (
        df.where(F.pmod(F.xxhash64(*keys, *order), F.lit(every)) == 0)
        .join(F.broadcast(hot), _same(keys, "_k_"))
        .select(*[f"_k_{k}" for k in keys], F.struct(*order).alias("_point"))
    )
    place = F.row_number().over(W.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_point"))
    cuts = (
        sample.withColumn("_n", place)
        .where(F.col("_n") % stride == 0)
        .groupBy(*[f"_k_{k}" for k in keys])
        .agg(F.array_sort(F.collect_list("_point")).alias("_cuts"))
    )
    rows = cuts.collect()  # at most MAX_CHUNKS points in all
    if not rows:
        return None
    table = df.sparkSession.createDataFrame(rows, cuts.schema)
    longest = max(len(r["_cuts"]) for r in rows)
    steps = [1 << i for i in reversed(range(longest.bit_length()))]
    value = F.struct(*order)
    # Binary search: number of cut points at or below the row.
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            F.get(F.col("_cuts"), at + step - 1) <= value, at + step
        ).otherwise(at),
    )
    return (
        df.join(F.broadcast(table), _same(keys, "_k_"), "left")
        .withColumn(CHUNK, F.when(F.col("_cuts").isNull(), 0).otherwise(found + 1))
        .drop("_cuts", *[f"_k_{k}" for k in keys])
    )


def mark_runs(data: Ordered, starts: Column, name: str) -> Ordered:
    """Number the runs of a key: a row where ``starts`` holds opens the next run."""
    return data.scan(upto={name: F.when(starts, 1).otherwise(0).cast("bigint")})


def collect_parts(
    df: DataFrame, keys, order, item: Column, name: str, size: int = 10_000
) -> DataFrame:
    """Ordered lists per key in parts of at most ``size`` items.

    ``part`` counts from 0; a key within ``size`` has the single part 0. Together the
    parts hold every item, while no list outgrows a row.
    """
    keys = _names(keys)
    numbered = ordered(df, keys, order).scan(number="_place").df
    part = F.floor((F.col("_place") - 1) / size).cast("bigint").alias("part")
    listed = F.array_sort(F.collect_list(F.struct(F.col("_place"), item.alias("v"))))
    return (
        numbered.groupBy(*keys, part)
        .agg(listed.alias("_list"))
        .select(*keys, "part", F.transform("_list", lambda x: x["v"]).alias(name))
    )


MOST_ITEMS = 20_000_000
"""Items whose text, about 12 bytes each in the saved formats, a row holds far below its limit of 2 GB."""


def lists_per_key(df: DataFrame, keys, order, item: Column, name: str, most: int = MOST_ITEMS) -> DataFrame:
    """The whole ordered list of every key, for formats that hold a key in one text.

    Rows: keys, ``items`` (how many), the list and ``reason``: null, or ``too_many`` with a
    null list where a key has more than ``most`` items and no row could hold its text.
    """
    keys, order = _names(keys), _names(order)
    fields = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], item.alias("_v"))
    rows = df.select(*keys, fields.alias("_item"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"))
    few = counts.where(F.col("items") <= most).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    lists = (
        rows.join(few, _same(keys, "_k_"), "left_semi").groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys])
        .agg(F.transform(F.array_sort(F.collect_list("_item")), lambda x: x["_v"]).alias(name))
    )
    return counts.join(lists, _same(keys, "_k_"), "left").select(
        *keys, "items", name, F.when(F.col("items") > most, "too_many").alias("reason")
    )


def _names(value) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value)


def _with(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    kept = [x for x in df.columns if x not in columns]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def _same(names, prefix: str) -> Column:
    parts = [F.col(n).eqNullSafe(F.col(f"{prefix}{n}")) for n in names]
    return reduce(lambda a, b: a & b, parts)
