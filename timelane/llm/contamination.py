"""Benchmark passages in documents by a prefix-filtered join.

A window is WINDOW successive words of an item (all of them, where the item has fewer). Its
tokens are shingles of five words. A document holds the whole window, so it holds all of its
shingles, and the necessary prefix is one shingle: the rarest of them over all documents. Only
places of such shingles are joined; length and position bounds cut what cannot fit, and the
words themselves are compared at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timelane.llm.bits import bit_field
from timelane.llm.store import stored
from timelane.llm.words import ALNUM_LOWER, shingle_sums, window_starts, word_slices

c = F.col

WINDOW = 13
SHINGLE = 5
FILTER_BITS = 23
"""The filter of shingles is 2**FILTER_BITS bits (1 MB), however many items there are."""


def item_windows(items: DataFrame, *, item: str = "item_id", text: str = "text",
                 window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Windows of all items and the shingles in each.

    Rows: ``item``, ``words`` (the window's words joined by one space), ``size``, ``at`` (the
    shingle's place in the window), ``width`` (its words) and ``token`` (its hash). An item
    without words has none.
    """
    def cut(batches):
        for batch in batches:
            keys = batch.column(0)
            rows = ([], [], [], [], [], [])
            for at, _, words in word_slices(batch.column(1), ALNUM_LOWER):
                sums = shingle_sums(words.hashes())
                for i, n in enumerate(words.counts().tolist()):
                    size, first = min(n, window), int(words.first[i])
                    width = min(size, shingle)
                    parts = words.of(i).split(b" ") if n else []
                    tokens = sums(np.arange(first, first + n - width + 1 if n else first), width).view(np.int64)
                    for w in range(n - size + 1 if n else 0):
                        whole = b" ".join(parts[w : w + size]).lower()
                        for k in range(size - width + 1):
                            token = int(tokens[w + k])
                            for to, v in zip(rows, (keys[at + i].as_py(), whole, size, k, width, token)):
                                to.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows, types)],
                names=["item", "words", "size", "at", "width", "token"],
            )

    types = [pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    return items.select(c(item).cast("string").alias("item"), c(text).cast("string").alias("text")).mapInArrow(
        cut, "item string, words binary, size int, at int, width int, token bigint"
    )


def _places(words, field, widths):
    """(width, first words, hashes) of shingles whose bit is set, over one slice."""
    sums = shingle_sums(words.hashes())
    for width in widths:
        start, text = window_starts(words, width)
        token = sums(start, width)
        hit = field.has(token)
        yield width, start[hit], text[hit], token[hit].view(np.int64)


def benchmark_windows(
    records: DataFrame, items: DataFrame, *, key: str = "mix", text: str = "text",
    item: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Every place where a whole window of an item stands in a text.

    ``records`` are saved mix files or any table with a whole-number key and a text. Rows: the
    key, ``item``, ``first`` (the window's first word in the text, from 0) and ``size``. Items
    that share a window each have a row; rows of ``records`` that are equal give equal places
    only once. Nulls have no words; an empty side gives no rows.
    """
    windows = stored(item_windows(items, item=item, text=item_text, window=window))
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # 5 at most
    spark = records.sparkSession
    texts = records.select(c(f"`{key}`").cast("bigint").alias("_key"), c(f"`{text}`").cast("string").alias("_text"))
    every = spark.sparkContext.broadcast(bit_field(windows.select("token"), FILTER_BITS))

    def count(batches):
        for batch in batches:
            for _, _, words in word_slices(batch.column(0), ALNUM_LOWER):
                for width, _, _, token in _places(words, every.value, widths):
                    token, n = np.unique(token, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(token), width, np.int32)), pa.array(token), pa.array(n.astype(np.int64))],
                        names=["width", "token", "n"],
                    )

    # How often each shingle of an item occurs in all texts; absent ones rule their windows out.
    seen = (
        texts.select("_text").mapInArrow(count, "width int, token bigint, n bigint")
        .groupBy("width", "token").agg(F.sum("n").alias("n"))
    )
    rarest = Window.partitionBy("words").orderBy("n", "at")
    prefix = stored(
        windows.select("words", "size", "at", "width", "token").distinct()
        .join(seen, ["width", "token"], "left")
        .select("words", "size", "at", "width", "token", F.coalesce("n", F.lit(0)).alias("n"),
                F.row_number().over(rarest).alias("_rank"))
        .where("_rank = 1 and n > 0").drop("_rank")
    )
    needed = spark.sparkContext.broadcast(bit_field(prefix.select("token"), FILTER_BITS))

    def find(batches):
        for batch in batches:
            keys = batch.column(0)
            for at, _, words in word_slices(batch.column(1), ALNUM_LOWER):
                counts = words.counts()
                for width, start, text, token in _places(words, needed.value, widths):
                    if not len(start):
                        continue
                    begin, end = words.first[text], words.first[text + 1]
                    low = np.maximum(start - (window - width), begin)
                    high = np.minimum(start + window, end)
                    around = [
                        b" ".join(words.data[s:e].tobytes().lower() for s, e in zip(words.start[a:b], words.end[a:b]))
                        for a, b in zip(low.tolist(), high.tolist())
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(at + text)), pa.array(np.full(len(start), width, np.int32)),
                            pa.array(token), pa.array(start - begin), pa.array(counts[text]),
                            pa.array(start - low), pa.array(around, pa.binary()),
                        ],
                        names=["_key", "width", "token", "place", "n_words", "lead", "around"],
                    )

    hits = texts.mapInArrow(
        find, "_key bigint, width int, token bigint, place bigint, n_words bigint, lead bigint, around binary"
    )
    first = c("place") - c("at")
    fits = (first >= 0) & (first + c("size") <= c("n_words"))
    whole = F.array_join(
        F.slice(F.split(F.decode("around", "UTF-8"), " "), (c("lead") - c("at") + 1).cast("int"), c("size")), " "
    )
    found = (
        hits.join(prefix.drop("n"), ["width", "token"]).where(fits)
        .where(F.encode(whole, "UTF-8") == c("words"))
        .select("_key", first.alias("first"), "size", "words")
        .distinct()
    )
    owners = windows.select("words", "item").distinct()
    return found.join(owners, "words").select(
        c("_key").alias(key), "item", c("first").cast("bigint").alias("first"), c("size").cast("int").alias("size")
    )


def word_counts(records: DataFrame, *, key: str = "mix", text: str = "text") -> DataFrame:
    """The key and ``n_words`` of every row, by this operator's words."""
    def count(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for at, to, words in word_slices(batch.column(1), ALNUM_LOWER):
                n[at:to] = words.counts()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=[key, "n_words"])

    return records.select(c(f"`{key}`").cast("bigint"), c(f"`{text}`").cast("string")).mapInArrow(
        count, f"`{key}` bigint, n_words bigint"
    )
