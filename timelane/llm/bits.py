"""Bit fields of fixed size that say which hashes occur somewhere; they never miss one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PART = 1 << 16


class BitField:
    """Packed bits, tested at the highest ``bits`` bits of hashes."""

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.bits = packed, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = _place(hashes, self.bits)
        byte = self.packed[(at >> np.uint64(3)).astype(np.int64)]
        return (byte >> (7 - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def bits_for(rows: int, most: int) -> int:
    """Bits for a field of which about a hundredth is set, within ``most``."""
    return min(most, max(16, int(64 * rows + 1).bit_length()))


def bit_field(hashes: DataFrame, bits: int, turn=None) -> BitField:
    """A field that has every value of the only column (long), after ``turn`` if given, and few others.

    Every task sends the parts of its field that are not empty; parts are joined before they
    reach the driver, so it gets 2**bits bits at most, whatever the table's size.
    """
    size = 1 << bits

    def build(batches):
        field = np.zeros(size, bool)
        for batch in batches:
            values = batch.column(0).to_numpy()
            field[_place(turn(values) if turn else values, bits).astype(np.int64)] = True
        for at in range(0, size, PART):
            part = field[at : at + PART]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at]), pa.array([np.packbits(part).tobytes()], pa.binary())],
                    names=["at", "part"],
                )

    def merge(key, table):
        parts = [np.frombuffer(p.as_py(), np.uint8) for p in table.column("part")]
        whole = np.bitwise_or.reduce(parts).tobytes()
        return pa.table({"at": pa.array([key[0].as_py()]), "part": pa.array([whole], pa.binary())})

    rows = hashes.mapInArrow(build, "at bigint, part binary").groupBy("at").applyInArrow(
        merge, "at bigint, part binary"
    )
    packed = np.zeros(size // 8, np.uint8)
    for row in rows.collect():
        part = np.frombuffer(row["part"], np.uint8)
        packed[row["at"] // 8 : row["at"] // 8 + len(part)] = part
    return BitField(packed, bits)


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes.view(np.uint64) >> np.uint64(64 - bits)
