"""Sums of whole sample arrays inside a task, over rows that lie sorted by their place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 2_000_000
"""Sums held at once: so many values of each side."""


def starts_of_runs(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one above in any of ``columns``; the first row does."""
    size = len(columns[0])
    opens = np.zeros(size, bool)
    opens[:1] = True
    for column in columns:
        a, b = column.slice(0, size - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        one_null = pc.xor(pc.is_null(a), pc.is_null(b))
        opens[1:] |= pc.or_(differ, one_null).to_numpy(zero_copy_only=False)
    return opens


class _Open:
    """The sums of the place that the rows seen so far end in."""

    def __init__(self, keys: int, width: int, schema: pa.Schema):
        self.keys, self.width, self.schema = keys, width, schema
        self.key, self.sums = None, None

    def feed(self, rows: pa.RecordBatch, firsts: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``sums`` (left, right, count) of the places whose first rows are ``firsts``."""
        head = [rows.column(i)[0].as_py() for i in range(self.keys)]
        if self.key == head:
            sums[0] += self.sums
        elif self.key is not None:
            yield from self.close()
        if len(firsts) > 1:
            yield self._batch([rows.column(i).take(pa.array(firsts[:-1])) for i in range(self.keys)], sums[:-1])
        self.key = [rows.column(i)[int(firsts[-1])].as_py() for i in range(self.keys)]
        self.sums = sums[-1]

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            keys = [pa.array([k], f.type) for k, f in zip(self.key, self.schema)]
            yield self._batch(keys, self.sums[None])
            self.key = None

    def _batch(self, keys, sums: np.ndarray) -> pa.RecordBatch:
        empty = (sums[:, 2] == 0).ravel()
        ends = pa.array(np.arange(0, sums.shape[0] * self.width + 1, self.width, dtype=np.int32))
        sides = [pa.ListArray.from_arrays(ends, pa.array(sums[:, i].ravel(), mask=empty)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*keys, *sides], schema=self.schema)


def _output(first: pa.RecordBatch, keys: int) -> pa.Schema:
    listed = pa.list_(pa.float64())
    return pa.schema([*[first.schema.field(i) for i in range(keys)], ("left", listed), ("right", listed)])


def weighted_sums(width: int, rate: float, keys: int):
    """Left and right sums of the blocks of each place, weighted by their gain pieces.

    For ``mapInArrow`` over rows sorted by the place (``keys`` columns, the second is the block),
    track and ``kind``. Kind 0 is a piece of a track's gain (low, high, t0, g0, t1, g1, easing,
    slider, l, r), kind 1 a block (start, values). A position no sample falls on is null.
    """
    def run(batches):
        carry, held = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, CELLS // width)):
                rows = batch.slice(at, max(1, CELLS // width))
                held = held or _Open(keys, width, _output(batch, keys))
                rows = rows if carry is None else pa.concat_batches([carry, rows])
                places = starts_of_runs([rows.column(i) for i in range(keys)])
                runs = np.cumsum(places | starts_of_runs([rows.column("track")]))
                piece = rows.column("kind").to_numpy() == 0
                firsts = np.flatnonzero(places)
                sums = _sum(rows, np.cumsum(places) - 1, runs, piece, len(firsts), width, rate)
                yield from held.feed(rows, firsts, sums)
                carry = rows.filter(pa.array(piece & (runs == runs[-1])))  # the track may go on
        if held:
            yield from held.close()

    return run


def _sum(rows, place, runs, piece, places: int, width: int, rate: float) -> np.ndarray:
    def numbers(name):
        return rows.column(name).cast(pa.float64()).fill_null(np.nan).to_numpy()

    lists = rows.column("values")
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    offsets = np.cumsum(sizes) - sizes
    flat = lists.flatten().cast(pa.float64()).fill_null(0.0).to_numpy()
    blocks, pieces = np.flatnonzero(~piece), np.flatnonzero(piece)
    start = rows.column("start").fill_null(0).to_numpy()
    inside = start - rows.column(1).fill_null(0).to_numpy() * width
    if ((inside[blocks] < 0) | (inside[blocks] + sizes[blocks] > width)).any():
        raise ValueError(f"a block does not lie inside its {width} frames")
    # every block meets all pieces of its track in this place
    low_at = np.searchsorted(runs[pieces], runs[blocks], side="left")
    n = np.searchsorted(runs[pieces], runs[blocks], side="right") - low_at
    b = np.repeat(blocks, n)
    p = pieces[np.repeat(low_at - (np.cumsum(n) - n), n) + np.arange(len(b))]
    low, high = (rows.column(x).fill_null(0).to_numpy() for x in ("low", "high"))
    begin = np.maximum(low[p], start[b])
    end = np.minimum(high[p], start[b] + sizes[b] - 1)
    met = end >= begin
    b, p, begin, end = b[met], p[met], begin[met], end[met]
    n = end - begin + 1
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    frame = np.repeat(begin, n) + step
    value = flat[np.repeat(offsets[b] + begin - start[b], n) + step]
    cell = np.repeat(place[b] * width + begin - start[b] + inside[b], n) + step

    t0, g0, t1, g1, slider, l, r = (numbers(x)[p] for x in ("t0", "g0", "t1", "g1", "slider", "l", "r"))
    easing = rows.column("easing").take(pa.array(p))
    flat_gain = np.select(
        [pc.equal(easing, x).fill_null(False).to_numpy(zero_copy_only=False) for x in ("slider", "hold")],
        [slider, g0], np.where(t1 - t0 <= 0, g1, np.nan))
    with np.errstate(all="ignore"):
        slope = np.repeat((g1 - g0), n) * ((frame / rate - np.repeat(t0, n)) / np.repeat(t1 - t0, n))
    gain = np.repeat(flat_gain, n)
    value = value * np.where(np.isnan(gain), np.repeat(g0, n) + slope, gain)
    sums = np.zeros((places, 3, width))
    for i, side in enumerate((value * np.repeat(l, n), value * np.repeat(r, n), None)):
        sums[:, i] = np.bincount(cell, side, places * width).reshape(places, width)
    return sums


def added_sums(width: int, keys: int):
    """The sums of the parts of each place added up; for ``mapInArrow`` over rows sorted by it."""
    def run(batches):
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, CELLS // width)):
                rows = batch.slice(at, max(1, CELLS // width))
                held = held or _Open(keys, width, _output(batch, keys))
                firsts = np.flatnonzero(starts_of_runs([rows.column(i) for i in range(keys)]))
                sides = [rows.column(x).flatten() for x in ("left", "right")]
                given = sides[0].is_valid().to_numpy(zero_copy_only=False).astype(float)
                whole = [s.fill_null(0.0).to_numpy().reshape(-1, width) for s in sides]
                parts = np.stack([*whole, given.reshape(-1, width)], axis=1)
                yield from held.feed(rows, firsts, np.add.reduceat(parts, firsts, axis=0))
        if held:
            yield from held.close()

    return run
