"""Directory trees stored as index ranges, and archives inside archives.

A tree is walked in the task that holds its table of contents; the driver only counts how
deep archives lie inside each other.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timelane.functions import scalars as S
from timelane.session import ensure_checkpoint_dir
from timelane.sources.containers import (
    ARCHIVE_SUFFIX, HEADER_SIZE, SECTOR, SLOT_SIZE, archive_header, archive_toc,
)

c = F.col


SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast a materialised table when its counted rows are few, else leave it."""
    if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return F.broadcast(df)
    return df


def directory_edges(toc: DataFrame, keys) -> DataFrame:
    """Parent and child index of every directory whose range lies inside the table."""
    end = c("child_index") + c("child_count")
    dirs = toc.where((c("kind") == S.DIRECTORY) & (c("child_count") > 0))
    inside = dirs.where(end <= c("entry_count"))
    return inside.select(
        *keys, c("idx").alias("parent"),
        F.explode(F.sequence(c("child_index"), end - 1)).alias("idx"),
    )


def bad_directories(toc: DataFrame, keys) -> DataFrame:
    """Archives that cannot be walked: a range outside the table or no root directory."""
    outside = (c("kind") == S.DIRECTORY) & (
        c("child_index") + c("child_count") > c("entry_count")
    )
    rootless = (c("idx") == 0) & (c("kind") != S.DIRECTORY)
    reason = F.when(rootless, "no_root").otherwise("range_out_of_bounds")
    return toc.where(outside | rootless).groupBy(*keys).agg(F.min(reason).alias("reason"))


def directory_faults(toc: DataFrame, keys) -> DataFrame:
    """Entries that a directory names although they have a place: ``cycle`` for the root,
    ``named_twice`` for others. Every way back up the tree ends at such an entry."""
    named = directory_edges(toc, keys).groupBy(*keys, "idx").agg(F.count(F.lit(1)).alias("_n"))
    reason = F.when(c("idx") == 0, "cycle").otherwise("named_twice")
    return named.where((c("_n") > 1) | (c("idx") == 0)).select(*keys, "idx", reason.alias("reason"))


def directory_paths(toc: DataFrame, keys) -> DataFrame:
    """``toc`` with the lower-cased inner path; entries no directory names keep ''.

    One exchange: a table of contents was read from one file's row, so it fits a task, which
    walks its directories level by level. An entry gets its path on the first level that
    names it (of two directories there, from the greater path), so overlapping ranges and cycles
    end; they are rows of :func:`directory_faults`.
    """
    lowered = toc.withColumn("_lower", F.lower("name"))
    schema = toc.schema.add("path", "string")

    def walk(table: pa.Table) -> pa.Table:
        return table.drop_columns("_lower").append_column("path", pa.array(_paths(table), pa.string()))

    return lowered.groupBy(*keys).applyInArrow(walk, schema)


def _paths(table: pa.Table) -> list[str]:
    columns = [table.column(n).to_pylist() for n in ("idx", "kind", "child_index", "child_count", "entry_count", "_lower")]
    entries = {row[0]: row[1:] for row in zip(*columns)}
    top = max(entries) + 2
    after = list(range(top + 1))  # the next entry from here on that no directory named yet

    def unnamed(i: int) -> int:
        while after[i] != i:
            after[i] = after[after[i]]
            i = after[i]
        return i

    paths: dict[int, str] = {}
    level = [0] if 0 in entries and entries[0][0] == S.DIRECTORY else []
    if level:
        paths[0], after[0] = "", 1
    while level:
        named = []
        # the greatest full path first, so that what two directories name goes to it
        for parent in sorted(level, key=lambda i: f"{paths[i]}/" if paths[i] else "", reverse=True):
            _, first, count, entry_count, _ = entries[parent]
            if not count or first + count > entry_count:
                continue
            up, end = paths[parent], min(first + count, top)
            i = unnamed(min(first, top))
            while i < end:
                if i in entries:
                    name = entries[i][4] or ""
                    paths[i] = f"{up}/{name}" if up else name
                    named.append(i)
                after[i] = i + 1
                i = unnamed(i + 1)
        level = [i for i in named if entries[i][0] == S.DIRECTORY]
    return [paths.get(i, "") for i in columns[0]]


def walk_archives(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of every archive and of the archives inside, and what could not be walked.

    ``files``: file, content. One round per nesting level, ended by a level without archives.
    Faults are rows (file, start, prefix, reason, offset): bad headers at any level, archives
    without a root or with a range outside of their table, entries of
    :func:`directory_faults`, and ``own_archive`` where an entry leads back to an archive
    that it lies in. Other archives and files go on.
    """
    ensure_checkpoint_dir(files.sparkSession)
    keys = ["file", "start", "prefix", "above"]
    fault = ["file", "start", "prefix", "reason", "offset"]
    archives = files.select(
        "file", "content", F.lit(0).cast("bigint").alias("start"), F.lit("").alias("prefix"),
        F.lit("0").alias("above"),
    )
    levels = faults = None
    while True:
        heads = archive_header(archives).where(c("reason").isNotNull()).select(
            "file", "start", "prefix", "reason", c("offset").cast("bigint").alias("offset"))
        toc = archive_toc(archives, keys).checkpoint()
        bad = bad_directories(toc, keys)
        good = toc.join(bad.select(*keys), keys, "left_anti")
        walked = directory_paths(good, keys)
        inner, prefix = c("path"), c("prefix")
        full = F.when(prefix == "", inner).when(inner == "", prefix).otherwise(
            F.concat_ws("/", prefix, inner)
        )
        rows = walked.select(
            *keys, "idx", "kind", full.alias("path"), F.lower("name").alias("name"),
            S.entry_size(c("kind"), c("file_size"), c("unpacked_size")).cast("bigint").alias("size"),
            S.entry_compressed(c("kind"), c("file_size")).alias("is_compressed"),
            S.entry_encrypted(c("kind"), c("encryption_type"), c("name")).alias("is_encrypted"),
            (c("start") + c("file_offset") * SECTOR).alias("data_offset"),
            F.when(c("file_size") == 0, c("unpacked_size")).otherwise(c("file_size")).alias(
                "stored_size"
            ),
        ).checkpoint()
        nested = rows.where((c("kind") == S.BINARY) & c("name").endswith(ARCHIVE_SUFFIX))
        back = F.array_contains(F.split("above", ","), c("data_offset").cast("string"))
        slot = (c("start") + HEADER_SIZE + c("idx") * SLOT_SIZE).alias("offset")
        found = heads.unionByName(
            bad.select("file", "start", "prefix", "reason", c("start").alias("offset"))
        ).unionByName(
            directory_faults(good, keys).select("file", "start", "prefix", "reason", slot)
        ).unionByName(
            nested.where(back).select("file", "start", "prefix", F.lit("own_archive").alias("reason"), slot)
        ).select(*fault).checkpoint()
        levels = rows if levels is None else levels.unionByName(rows)
        faults = found if faults is None else faults.unionByName(found)
        todo = nested.where(~back).select(
            "file", c("data_offset").alias("start"), c("path").alias("prefix"),
            F.concat_ws(",", "above", c("data_offset").cast("string")).alias("above"),
        )
        if todo.isEmpty():
            return levels.drop("above"), faults
        archives = files.select("file", "content").join(small(todo), "file")


def archive_entries(files: DataFrame) -> DataFrame:
    """Entries of :func:`walk_archives`, with full paths."""
    return walk_archives(files)[0]


def archive_faults(files: DataFrame) -> DataFrame:
    """Faults of :func:`walk_archives`: reason and offset of all that could not be walked."""
    return walk_archives(files)[1]


def search_entries(entries: DataFrame, query: str) -> DataFrame:
    """Rows whose name or path holds the text, any case; blank finds all."""
    q = query.strip().lower()
    if not q:
        return entries
    return entries.where(F.lower("name").contains(q) | F.lower("path").contains(q))


def entries_by_suffix(entries: DataFrame, suffix: str) -> DataFrame:
    return entries.where((c("kind") != S.DIRECTORY) & F.lower("name").endswith(suffix))


def _in_order(key: str, ord: str, descending: bool):
    value = c(key) if key == "size" else F.collate(c(key), "UNICODE")
    return [value.desc() if descending else value.asc(), F.asc(ord)]


def sort_entries(entries: DataFrame, key: str, ord: str, descending: bool = False) -> DataFrame:
    """By size, or by name or path in the reader's alphabet; ties keep their input order."""
    return entries.orderBy(*_in_order(key, ord, descending))


def ranked_entries(
    entries: DataFrame, key: str, ord: str, descending: bool = False, place: str = "place"
) -> DataFrame:
    """``entries`` with their place from 1 in the order of :func:`sort_entries`.

    Rows are exchanged by ranges of the order and numbered inside each; the number of rows in
    the ranges before, one small row per range, is added. No task sees all rows.
    """
    ensure_checkpoint_dir(entries.sparkSession)
    order = _in_order(key, ord, descending)
    ranges = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, as the numbers of a range must not change between counting and use.
    rows = entries.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(
        "_id", F.monotonically_increasing_id()).checkpoint()
    piece = F.call_function("shiftright", c("_id"), F.lit(33))
    sizes = rows.groupBy(piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_piece", before.alias("_before")))
    inside = c("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(starts, piece == c("_piece")).withColumn(place, c("_before") + inside + 1).drop(
        "_id", "_piece", "_before")
