"""Whitening of fixed-length sample windows: block QR over Spark, then a small bidiagonal problem."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from timelane.llm.bidiagonal import singular_directions
from timelane.llm.store import stored

c = F.col
MOST = 16
"""Components a window is projected on."""
STEPS, ORIGIN = 64, 1_000_000
"""An entry ``v`` becomes the integer ``floor(STEPS * v) + ORIGIN``."""
FARTHEST = 1 << 40
"""Entries whose integer would leave ``ORIGIN`` +- this are taken as not finite."""
BLOCK = 8_192
"""Rows of one step of a QR."""
FAN = 16
"""Triangles stacked in one task at each level of the tree."""
_X = np.dtype("<i8")


@dataclass
class Whitener:
    """Means, directions and sizes of the components of the different windows of a table."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, falling
    trace: float
    vectors: np.ndarray  # unit columns

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``x``, centred, along the components, each over its standard deviation."""
        return (self.centred(x) @ self.vectors) / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean; whole parts are taken off as integers, so nothing is rounded away."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over the entries of (n x - sum) squared; None beyond a long."""
        near = self.centred(x)
        top = float(np.abs(near).max()) * self.n if near.size else 0.0
        if top * top * x.shape[1] < 2.0**62 and float(np.abs(x).max(initial=0)) * self.n < 2.0**62:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((v * self.n - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _X).reshape(-1, dims)


def window_integers(windows: DataFrame, keys, values: str, dims: int) -> DataFrame:
    """``keys`` and ``x``: the integers of each window of ``dims`` finite values, packed."""
    fields = [windows.schema[k] for k in keys]
    schema = StructType([*fields, *StructType.fromDDL("x binary").fields])

    def pack(batches):
        for batch in batches:
            lists = batch.column(len(keys))
            flat = lists.flatten()
            lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            fits = np.flatnonzero(lengths == dims)
            begin = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
            given = flat.is_valid().to_numpy(zero_copy_only=False)
            raw = flat.cast(pa.float64()).fill_null(np.nan).to_numpy()
            at = begin[fits, None] + np.arange(dims)
            with np.errstate(all="ignore"):
                steps = np.floor(raw[at] * STEPS)
                good = given[at].all(axis=1) & (np.abs(steps) < FARTHEST).all(axis=1)
            x = steps[good].astype(np.int64) + ORIGIN
            data = x.astype(_X).tobytes()
            size = dims * _X.itemsize
            packed = pa.array([data[i : i + size] for i in range(0, len(data), size)], pa.binary())
            kept = pa.array(fits[good])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(kept) for i in range(len(keys))], packed], names=schema.names)

    listed = F.col(values).cast("array<double>")
    return windows.select(*keys, listed.alias("_values")).mapInArrow(pack, schema)


def common_length(windows: DataFrame, values: str) -> int:
    """The length that most windows have, the longest of those; 0 without any."""
    sizes = windows.where(F.size(values) > 0).groupBy(F.size(values).alias("d")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    def add(batches):
        n, total = 0, np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n, total = n + len(x), total + (x - ORIGIN).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims)), pa.array(total), pa.array(np.full(dims, n))], names=["d", "s", "n"])

    parts = fit.mapInArrow(add, "d bigint, s bigint, n bigint")
    whole = F.sum(c("s").cast("decimal(38,0)")).alias("s")  # exact past a long
    rows = parts.groupBy("d").agg(whole, F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: r["d"])
    n = rows[0]["n"] if rows else 0
    return n, [int(r["s"]) + ORIGIN * n for r in rows]


def _triangle(parts) -> np.ndarray:
    return np.linalg.qr(np.concatenate(parts), mode="r")


def reduced_rows(fit: DataFrame, dims: int, centre: Whitener) -> np.ndarray:
    """The triangle ``r`` of the QR of all centred rows: one per task, stacked up a tree.

    ``r.T @ r`` is the sum of products of the centred rows, which is never formed itself, so small
    directions keep their digits.
    """
    def block(batches):
        r = np.zeros((0, dims))
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for at in range(0, len(x), BLOCK):
                r = _triangle([r, centre.centred(x[at : at + BLOCK])])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def stack(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(v, float).reshape(-1, dims) for v in table["r"].to_pylist()]
        place = table["at"][0].as_py() // FAN
        return pa.table({"at": pa.array([place], pa.int64()), "r": pa.array([_triangle(parts).tobytes()], pa.binary())})

    level = stored(fit.mapInArrow(block, "r binary").withColumn("at", F.monotonically_increasing_id()))
    # places from 0 in a row: one narrow row per task is ranked
    ids = sorted(r["at"] for r in level.select("at").collect())
    ranks = level.sparkSession.createDataFrame(list(enumerate(ids)) or [], "at bigint, _id bigint")
    level = level.withColumnRenamed("at", "_was").join(F.broadcast(ranks), c("_was") == c("_id")).select("at", "r")
    parts = len(ids)
    while parts > 1:
        level = level.groupBy(F.floor(c("at") / FAN).alias("_up")).applyInArrow(stack, "at bigint, r binary")
        parts = -(-parts // FAN)
    top = level.select("r").first()
    return np.frombuffer(top["r"], float).reshape(-1, dims) if top else np.zeros((0, dims))


def fit_whitener(fit: DataFrame, dims: int, most: int = MOST) -> Whitener | None:
    """Whitener of the windows ``fit`` (column ``x``, each once); None without any.

    Directions in which the windows do not differ (singular values lost in rounding) are none.
    """
    n, sums = _sums(fit, dims)
    if not n:
        return None
    centre = Whitener(n, sums, np.empty(0), 0.0, np.empty((dims, 0)))
    r = reduced_rows(fit, dims, centre)
    squares, vectors = singular_directions(r)
    floor = (dims * np.finfo(float).eps) ** 2 * squares[0] if len(squares) else 0.0
    real = squares > floor
    return Whitener(n, sums, squares[real][:most] / n, float(squares.sum() / n), vectors[:, real][:, :most])


def identity_error(fit: DataFrame, dims: int, whitener: Whitener) -> float:
    """Largest entry of the whitened windows' covariance less the identity, over all of ``fit``."""
    k = len(whitener.values)

    def add(batches):
        total, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for at in range(0, len(x), BLOCK):
                w = whitener.whiten(x[at : at + BLOCK])
                total, mean = total + w.T @ w, mean + w.sum(axis=0)
        cells = np.concatenate([total.ravel(), mean])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "v"])

    rows = fit.mapInArrow(add, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    cells = np.zeros(k * k + k)
    for r in rows:
        cells[r["cell"]] = r["v"] / whitener.n
    mean = cells[k * k :]
    return float(np.abs(cells[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


RESULTS = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten_windows(
    windows: DataFrame, keys=("mix", "track", "start"), values: str = "values", most: int = MOST
) -> DataFrame:
    """Sample windows of one length along the directions in which such windows differ most.

    ``windows``: sample blocks (mix, track, start, values), or any vectors named by ``keys``.
    Each entry becomes an integer (``floor(64 v) + 1000000``), and each different window counts
    once in the fit, so silence and copies do not weigh. One row per window and component,
    from 1 by falling eigenvalue: ``n`` different windows, ``deviation`` (exact sum of
    (n x - sum) squared; null beyond a long), ``whitened``, ``explained`` (the component's part of
    all variance) and ``identity_error`` (one value: how far the whitened windows are
    from unit covariance).

    Left out are windows that are null, hold null or non-finite entries or entries beyond 2**34, or are
    not as long as most (a short last block). Without differing windows there are no components and no
    rows. Repeated rows, equal and null keys all stay; other columns are not read;
    signs of components are free but the same for all rows.

    The different windows are found by a grouping that is combined before its exchange; sums, the
    triangles of a blockwise QR and the check are one small row per task. The driver holds one
    ``d x d`` triangle and the components for windows of ``d`` values, and 16 bytes per task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = [x.split()[0] for x in RESULTS.split(", ")]
    if set(keys) & {*names, "x", "_values"}:
        raise ValueError("a key is named like a result")
    schema = StructType([*[windows.schema[k] for k in keys], *StructType.fromDDL(RESULTS).fields])
    dims = common_length(windows, values)
    none = windows.sparkSession.createDataFrame([], schema)
    if not dims:
        return none
    rows = window_integers(windows, keys, values, dims)
    fit = stored(rows.select("x").distinct())
    whitener = fit_whitener(fit, dims, most)
    if whitener is None or not len(whitener.values):
        return none
    error = identity_error(fit, dims, whitener)
    k = len(whitener.values)
    explained = whitener.values / whitener.trace

    def project(batches):
        for batch in batches:
            x = _matrix(batch.column(len(keys)), dims)
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            deviation = pa.array(whitener.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i).take(each) for i in range(len(keys))],
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, whitener.n)), deviation.take(each),
                pa.array(whitener.whiten(x).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ], names=schema.names)

    return rows.mapInArrow(project, schema)
