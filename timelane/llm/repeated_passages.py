"""Passages that an earlier text holds too, found with a count-min prefilter.

A window is WINDOW successive words. Its anchor is the least hash among its shingles of
GRAM words, so equal windows have equal anchors wherever they stand, and neighbouring windows
mostly share theirs. The first pass counts windows in count-min sketches, a run of windows with
one anchor as one entry; a sketch may count too high, never too low. The second pass groups
exactly, and only what the merged sketch says may occur twice: first whole runs, then, where an
anchor has runs that differ, the single windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelane.llm.bits import bit_field, bits_for
from timelane.llm.store import small_ids, stored
from timelane.llm.tokens import forget_texts
from timelane.llm.words import SPACED, Words, mix, shingle_sums, window_starts, word_slices

c = F.col

WINDOW = 50
GRAM = 8
SKETCH_ROWS = 2
WIDEST = 24
"""A row of the sketch has 2**WIDEST one-byte counters at most; larger corpora fill it more, and
more windows reach the second pass."""
FIELD_BITS = 27
_CHUNK = 1 << 16


def _anchors(words: Words, window: int, gram: int):
    """Of all windows in a slice: first word, text, and anchor; text by text in order."""
    start, text = window_starts(words, window)
    h = words.hashes()
    sums = shingle_sums(h)
    value = mix(sums(np.arange(max(len(h) - gram + 1, 0)), gram))
    # Minimum over the shingles of a window: two overlapping spans of a power of two.
    span, width = window - gram + 1, 1
    while 2 * width <= span:
        value = np.minimum(value[: len(value) - width], value[width:])
        width *= 2
    least = np.minimum(value[start], value[start + span - width]) if len(start) else start.astype(np.uint64)
    return start, text, mix(least), h  # minima crowd at the low end


def _runs(text: np.ndarray, anchor: np.ndarray):
    """Where runs of windows with one text and anchor begin, and how long they are."""
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(text)))


def _names(words: Words, h: np.ndarray, start: np.ndarray, width):
    """128-bit names of word spans, as two signed columns."""
    second = words.hashes(1)
    return [mix(shingle_sums(x, lane)(start, width)).view(np.int64) for lane, x in enumerate((h, second))]


def window_runs(records: DataFrame, *, key: str = "mix", text: str = "text",
                window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of successive windows with the same anchor.

    Rows: ``text`` (the key), ``anchor``, ``first`` (first window of the run, from 0),
    ``windows``, and a 128-bit name of all its words (``run_a``, ``run_b``).
    """
    def find(batches):
        forget_texts()
        for batch in batches:
            keys = batch.column(0)
            for row, _, words in word_slices(batch.column(1), SPACED):
                start, text_, anchor, h = _anchors(words, window, gram)
                at, n = _runs(text_, anchor)
                if not len(at):
                    continue
                a, b = _names(words, h, start[at], n + window - 1)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row + text_[at])), pa.array(anchor[at].view(np.int64)),
                     pa.array(start[at] - words.first[text_[at]]), pa.array(n), pa.array(a), pa.array(b)],
                    names=["text", "anchor", "first", "windows", "run_a", "run_b"],
                )

    return _texts(records, key, text).mapInArrow(
        find, "text bigint, anchor bigint, first bigint, windows bigint, run_a bigint, run_b bigint")


def _texts(records: DataFrame, key: str, text: str) -> DataFrame:
    return records.select(c(f"`{key}`").cast("bigint").alias("k"), c(f"`{text}`").cast("string").alias("t")).where(
        "k is not null")


def _cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    salt = np.uint64(row * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return mix(anchor.view(np.uint64) ^ salt) >> np.uint64(64 - bits)


def count_min(anchors: DataFrame, bits: int) -> np.ndarray:
    """Merged sketch of the only column (long): SKETCH_ROWS rows of 2**bits saturating bytes.

    Each task sends the chunks of its own sketch that are not empty; chunks are added before
    the driver gets them, which holds one sketch of bounded size.
    """
    size = SKETCH_ROWS << bits

    def build(batches):
        sketch = np.zeros(size, np.uint8)
        for batch in batches:
            values = batch.column(0).to_numpy()
            for row in range(SKETCH_ROWS):
                cell, n = np.unique(_cells(values, row, bits), return_counts=True)
                part = sketch[row << bits : (row + 1) << bits]
                part[cell] = np.minimum(part[cell].astype(np.int64) + n, 255)
        for at in range(0, size, _CHUNK):
            part = sketch[at : at + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at]), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])

    def merge(key, table):
        total = np.zeros(_CHUNK, np.int64)
        for p in table.column("part"):
            p = np.frombuffer(p.as_buffer(), np.uint8)
            total[: len(p)] += p
        return pa.table({"at": pa.array([key[0].as_py()]),
                         "part": pa.array([np.minimum(total, 255).astype(np.uint8).tobytes()], pa.binary())})

    sketch = np.zeros(size, np.uint8)
    rows = anchors.mapInArrow(build, "at bigint, part binary").groupBy("at").applyInArrow(merge, "at bigint, part binary")
    for row in rows.collect():  # chunks of one sketch
        part = np.frombuffer(row["part"], np.uint8)[: size - row["at"]]
        sketch[row["at"] : row["at"] + len(part)] = part
    return sketch


def repeated_spans(records: DataFrame, *, key: str = "mix", text: str = "text",
                   window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Spans of words that lie in windows which also start in a text with a smaller key.

    Rows: the key, ``first`` (word, from 0) and ``size`` (words). Spans of a text may overlap.
    Rows that share a key are one text to this rule: they never repeat each other. Nulls and
    texts of fewer than ``window`` words have no window.
    """
    spark = records.sparkSession
    runs = stored(window_runs(records, key=key, text=text, window=window, gram=gram))
    bits = min(WIDEST, max(12, int(4 * runs.count() + 1).bit_length()))
    sketch = spark.sparkContext.broadcast(count_min(runs.select("anchor"), bits))

    def repeated(batches):
        for batch in batches:
            values = batch.column("anchor").to_numpy()
            often = np.ones(len(values), bool)
            for row in range(SKETCH_ROWS):
                often &= sketch.value[(row << bits) + _cells(values, row, bits).astype(np.int64)] > 1
            yield batch.filter(pa.array(often))

    maybe = runs.mapInArrow(repeated, runs.schema)
    # Whole runs: the first text of each, and anchors whose runs differ.
    first = maybe.groupBy("anchor", "run_a", "run_b").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    first = stored(first)
    whole = (
        maybe.join(first.where("low < high").select(c("run_a").alias("ra"), c("run_b").alias("rb"), "low",
                                                    c("anchor").alias("an")),
                   (c("anchor") == c("an")) & (c("run_a") == c("ra")) & (c("run_b") == c("rb")))
        .where("text > low").select("text", "first", (c("windows") + window - 1).alias("size"))
    )
    unlike = first.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("low").alias("l"), F.max("high").alias("h")).where("n > 1 and l < h")
    unlike = stored(unlike.select("anchor"))
    field = spark.sparkContext.broadcast(bit_field(unlike, bits_for(unlike.count(), FIELD_BITS)))

    def single(batches):
        for batch in batches:
            keys = batch.column(0)
            for row, _, words in word_slices(batch.column(1), SPACED):
                start, text_, anchor, h = _anchors(words, window, gram)
                pick = field.value.has(anchor)
                if not pick.any():
                    continue
                start, text_ = start[pick], text_[pick]
                a, b = _names(words, h, start, window)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row + text_)), pa.array(start - words.first[text_]), pa.array(a), pa.array(b)],
                    names=["text", "first", "win_a", "win_b"],
                )

    # Found twice, for the group and for the join: cheaper than to write every window once.
    windows = _texts(records, key, text).mapInArrow(
        single, "text bigint, first bigint, win_a bigint, win_b bigint")
    lows = windows.groupBy(c("win_a").alias("wa"), c("win_b").alias("wb")).agg(
        F.min("text").alias("low"), F.max("text").alias("high")).where("low < high")
    alone = windows.join(lows, (c("win_a") == c("wa")) & (c("win_b") == c("wb"))).where("text > low").select(
        "text", "first", F.lit(window).cast("bigint").alias("size"))
    return whole.unionByName(alone).select(c("text").alias(key), "first", "size")


def remove_repeated(records: DataFrame, *, key: str = "mix", text: str = "text",
                    window: int = WINDOW) -> DataFrame:
    """``records`` without the words of ``repeated_spans``.

    ``records`` are saved mix files or any table with a whole-number key and a text; all their
    columns are returned, with ``n_words`` and ``n_removed`` (long) behind them (columns of
    these names are replaced). A text that loses nothing stays as it is, null included. In
    another one the words that are left keep what stood between them, and one space closes each
    gap. Equal rows and rows with a null key stay; an empty table gives no rows.
    """
    names = [n for n in records.columns if n.lower() not in ("n_words", "n_removed")]
    spans = repeated_spans(records, key=key, text=text, window=window)
    # At most one span a word of the text itself.
    cuts = stored(spans.groupBy(c(key).alias("_cut_key")).agg(F.collect_list(F.struct("first", "size")).alias("_cuts")))
    touched = small_ids(cuts.select(c("_cut_key").alias("_id")))
    given = records.select(*[c(f"`{n}`") for n in names])
    # Only texts that lose words meet their spans by exchange.
    some = given.join(touched, c(f"`{key}`") == c("_id"), "left_semi").join(cuts, c(f"`{key}`") == c("_cut_key"))
    other = given.join(touched, c(f"`{key}`") == c("_id"), "left_anti")
    rows = some.drop("_cut_key").unionByName(other.withColumn("_cuts", F.lit(None).cast(cuts.schema["_cuts"].dataType)))
    place_of = names.index(next(n for n in names if n.lower() == text.lower()))

    def cut(batches):
        for batch in batches:
            texts, total, gone = [], [], []
            spans = batch.column(len(names))
            for row, to, words in word_slices(batch.column(place_of), SPACED):
                counts = words.counts()
                for i in range(to - row):
                    total.append(int(counts[i]))
                    mine = spans[row + i].as_py()
                    if not mine:
                        gone.append(0)
                        texts.append(batch.column(place_of)[row + i].as_py())
                        continue
                    left = _left(words, i, mine)
                    gone.append(int(counts[i]) - sum(b - a for a, b in left))
                    texts.append(b" ".join(
                        words.data[words.start[a] : words.end[b - 1]].tobytes() for a, b in left).decode())
            columns = [batch.column(i) for i in range(len(names))]
            columns[place_of] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_words", "n_removed"])

    fields = records.select(*[c(f"`{n}`") for n in names]).withColumn(names[place_of], c(f"`{names[place_of]}`").cast("string"))
    rows = rows.withColumn(names[place_of], c(f"`{names[place_of]}`").cast("string"))
    return rows.mapInArrow(cut, fields.schema.add("n_words", "long").add("n_removed", "long"))


def _left(words: Words, i: int, spans: list[dict]) -> list[tuple[int, int]]:
    """Word ranges of text ``i`` (places in ``words``) outside of the spans."""
    base, end = int(words.first[i]), int(words.first[i + 1])
    edge = np.zeros(end - base + 1, np.int64)
    first = np.array([s["first"] for s in spans])
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + np.array([s["size"] for s in spans]), end - base), -1)
    keep = np.concatenate([[False], np.cumsum(edge[:-1]) == 0, [False]])
    turn = np.flatnonzero(keep[1:] != keep[:-1]) + base
    return list(zip(turn[::2].tolist(), turn[1::2].tolist()))

