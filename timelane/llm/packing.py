"""Packing token sequences into windows of one size by best-fit decreasing.

The order of best-fit decreasing depends on lengths alone, and a length is at most one window,
so the plan is made from the count of pieces of each length: never more than ``window``
numbers, however large the corpus. Pieces then learn their rank among the pieces of the same
length, and a rank has one place in the plan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timelane.llm.store import stored
from timelane.llm.tokens import encoder

WINDOW = 2048
END_ID = 1

c = F.col


def cut_windows(
    records: DataFrame, vocabulary: str, *, key: str = "mix", text: str = "text",
    window: int = WINDOW, end_id: int = END_ID,
) -> DataFrame:
    """Token ids of whole texts, cut into full windows and one shorter piece.

    Takes saved mix files (``mix``, ``text``) or any table with a whole-number key and a
    text; other columns are left out. Rows of the result: the key, ``start`` (ids of the text
    before the piece), ``length``, ``total`` (ids of the text with its end id) and ``ids``
    (little-endian unsigned 32-bit). A null or empty text is the end id alone. A null key
    stays null and equal rows stay apart. An empty table gives no rows.
    """
    def cut(batches):
        tok, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = ([], [], [], [], [])
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tok.encode(t.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    for to, value in zip(rows, (k, start, len(piece) // 4, total, piece)):
                        to.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows, types)], names=[key, *names]
            )

    names = ["start", "length", "total", "ids"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return records.select(c(key).cast("bigint").alias(key), c(text).cast("string").alias("text")).mapInArrow(
        cut, f"`{key}` bigint, start bigint, length bigint, total bigint, ids binary"
    )


class OpenWindows:
    """Counts of open windows by what still fits into them, in a segment tree."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, room: int, count: int) -> None:
        at = self.leaves + room
        while at:
            self.tree[at] += count
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that an open window has."""
        at = self.leaves + least
        if self.tree[at]:
            return least
        while at > 1:  # up to the first subtree to the right that is not empty
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.leaves:
            at = 2 * at + (not self.tree[2 * at])
        return at - self.leaves


def plan_best_fit(counts: dict[int, int], window: int) -> np.ndarray:
    """Places of all pieces, from the number of pieces of each length.

    Rows (length, first rank, pieces, first window, offset): the pieces of that length from
    the first rank on lie in successive windows at the offset. Windows that look alike are
    planned as one, so the work depends on the lengths and not on the number of pieces.
    """
    groups: dict[int, list] = {}  # room -> [(windows alike, [(length, first rank, offset)])]
    tree = OpenWindows(window)
    done = []

    def fill(alike: int, held: list, room: int, length: int, first: int, each: int) -> None:
        """``each`` pieces more in every one of the windows; ranks run over the windows first."""
        for i in range(each):
            held = [*held, (length, first + i * alike, window - room + i * length)]
        room -= each * length
        if room:
            groups.setdefault(room, []).append((alike, held))
            tree.add(room, alike)
        else:
            done.append((alike, held))

    for length in sorted((n for n, k in counts.items() if k), reverse=True):
        left, first = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                each = min(window // length, left)
                alike, held, room = left // each, [], window
            else:
                alike, held = groups[room].pop()
                tree.add(room, -alike)
                each = min(room // length, left)
                use = min(alike, left // each)
                if use < alike:  # the windows behind keep their place in the ranks
                    groups[room].append((alike - use, [(n, r + use, o) for n, r, o in held]))
                    tree.add(room, alike - use)
                alike = use
            fill(alike, held, room, length, first, each)
            first += alike * each
            left -= alike * each
    rows, base = [], 0
    for alike, held in [*done, *(g for same in groups.values() for g in same)]:
        rows += [(length, rank, alike, base, offset) for length, rank, offset in held]
        base += alike
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def best_fit_windows(
    pieces: DataFrame, *, key: str = "mix", window: int = WINDOW, start: str = "start",
    length: str = "length",
) -> DataFrame:
    """Give each piece its window ``sequence_id`` and its ``offset`` there.

    Windows are filled by best-fit decreasing over all pieces: the longest piece first, each
    into the open window with the least room that holds it. Offsets have no gaps from 0.
    ``length`` is from 1 to ``window``; another value ends the job with an error. All columns of
    ``pieces`` are kept (one named ``sequence_id`` or ``offset`` is replaced). Rows that are
    equal in key and start get places of their own. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    kept = [n for n in pieces.columns if n.lower() not in ("sequence_id", "offset")]
    order = [c(f"`{key}`"), c(f"`{start}`")]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(
        pieces.select(
            *[c(f"`{n}`") for n in kept],
            c(f"`{length}`").cast("bigint").alias("_size"),
            F.pmod(F.xxhash64(*order), F.lit(buckets)).alias("_bucket"),
        )
    )
    # A length that a third of all pieces share is still spread over the buckets.
    sizes = rows.groupBy("_size", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_size", "_bucket",
        (F.sum("_n").over(Window.partitionBy("_size").orderBy("_bucket")) - c("_n")).alias("_before"),
    )
    counts = {r["_size"]: r["n"] for r in sizes.groupBy("_size").agg(F.sum("_n").alias("n")).limit(window + 1).collect()}
    if any(n is None or not 1 <= n <= window for n in counts):
        raise ValueError(f"pieces must have a length from 1 to {window}")
    plan = spark.sparkContext.broadcast(plan_best_fit(counts, window))
    ranked = (
        rows.join(before.withColumnsRenamed({"_size": "_s", "_bucket": "_b"}),
                  (c("_size") == c("_s")) & (c("_bucket") == c("_b")))
        .withColumn("_rank", c("_before") - 1 + F.row_number().over(
            Window.partitionBy("_size", "_bucket").orderBy(*order)))
        .drop("_s", "_b", "_before", "_bucket")
    )

    def place(batches):
        table = plan.value
        place_of = table[:, 0] << np.int64(48) | table[:, 1]
        for batch in batches:
            size = batch.column("_size").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(place_of, size << np.int64(48) | rank, side="right") - 1
            hit = table[at] if len(table) else np.empty((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(kept))]
                + [pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])],
                names=[*kept, "sequence_id", "offset"],
            )

    schema = rows.select(*[c(f"`{n}`") for n in kept]).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*[c(f"`{n}`") for n in kept], "_size", "_rank").mapInArrow(place, schema)
