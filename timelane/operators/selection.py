"""Selections of (pair, idx) refs, kept as plain key tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelane.operators.ordered import ordered

c = F.col
REF = ["pair", "idx"]


def toggle_refs(selected: DataFrame, toggled: DataFrame) -> DataFrame:
    """Symmetric difference: present refs leave, absent ones enter."""
    cols = selected.columns
    marks = selected.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        toggled.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    seen = marks.groupBy(*cols).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return seen.where(c("_a") != c("_b")).select(*cols)


def remove_groups(selected: DataFrame, pairs: DataFrame) -> DataFrame:
    return selected.join(pairs.select("pair"), "pair", "left_anti")


def prune_selection(selected: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop removed refs and move the later ones of a pair down.

    Both tables are sorted together once per pair; a running count of removals replaces
    the comparison of every pair of refs.
    """
    both = selected.select(*REF, F.lit(0).alias("_gone"), F.lit(1).alias("_sel")).unionByName(
        removed.select(*REF).distinct().select(*REF, F.lit(1).alias("_gone"), F.lit(0).alias("_sel"))
    )
    slots = both.groupBy(*REF).agg(F.max("_gone").alias("_gone"), F.max("_sel").alias("_sel"))
    counted = ordered(slots, "pair", "idx").scan(before={"_below": c("_gone")}).df
    kept = counted.where((c("_sel") == 1) & (c("_gone") == 0))
    return kept.select("pair", (c("idx") - c("_below")).alias("idx"))


def in_range(refs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Refs between an anchor and a target of the same pair, both included, in any order.

    ``ranges``: pair (target), idx_a, idx_b and anchor_pair; with another anchor pair only
    the target ref is taken. At most one range per pair.
    """
    low = F.least("idx_a", "idx_b")
    high = F.greatest("idx_a", "idx_b")
    same = c("anchor_pair") == c("pair")
    inside = F.when(same, c("idx").between(low, high)).otherwise(c("idx") == c("idx_b"))
    return refs.join(ranges, "pair").where(inside).select(*refs.columns)


def selected_indices(selected: DataFrame) -> DataFrame:
    """The distinct indexes of each pair with their place, from 0, in index order."""
    numbered = ordered(selected.select("pair", "idx").distinct(), "pair", "idx").scan(number="_n").df
    return numbered.select("pair", (c("_n") - 1).alias("position"), "idx")


def selection_summary(selected: DataFrame, keys) -> DataFrame:
    """Refs and distinct pairs of each selection."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    # Counting pair by pair first keeps a large selection out of a single task.
    per_pair = selected.groupBy(*keys, "pair").agg(F.count(F.lit(1)).alias("_n"))
    return per_pair.groupBy(*keys).agg(
        F.sum("_n").alias("refs"), F.count(F.lit(1)).alias("pairs")
    )


def set_fingerprint(selected: DataFrame, keys, prefix: str) -> DataFrame:
    """One value that names the set of refs, the same for every input order.

    It holds the number of distinct refs and two sums over halves of their hashes, which are
    combined before the shuffle however large the set is.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ref = F.concat_ws(".", c("pair").cast("string"), c("idx").cast("string"))
    refs = selected.select(*keys, F.md5(ref).alias("_h")).distinct()

    def half(start: int) -> Column:
        value = F.conv(F.substring("_h", start, 15), 16, 10).cast("decimal(20,0)")
        return F.sum(value).cast("string")

    value = F.concat_ws("-", F.count(F.lit(1)).cast("string"), half(1), half(16))
    return refs.groupBy(*keys).agg(F.concat(F.lit(prefix), value).alias("fingerprint"))


def membership(refs: DataFrame, selected: DataFrame) -> DataFrame:
    """Whether each ref, and its pair, is selected."""
    s = selected.select(*REF).distinct().withColumn("_sel", F.lit(True))
    p = selected.select("pair").distinct().withColumn("_pair", F.lit(True))
    joined = refs.join(s, REF, "left").join(p, "pair", "left")
    return joined.select(
        *refs.columns, F.coalesce("_sel", F.lit(False)).alias("is_selected"),
        F.coalesce("_pair", F.lit(False)).alias("pair_selected"),
    )


def single_selected(selected: DataFrame, keys) -> DataFrame:
    """The one ref of selections that hold exactly one."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (
        selected.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.first("pair").alias("pair"), F.first("idx").alias("idx"))
        .where(c("_n") == 1).drop("_n")
    )
