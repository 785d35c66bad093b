"""Stored sessions: newest first, pruning, upserts, deletes and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col
KEEP = 5


def _list(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def recent_sessions(sessions: DataFrame, created: str, ord: str, keep: int = KEEP) -> DataFrame:
    """Newest first; ties keep their input order. A top-k, no full sort."""
    return sessions.orderBy(F.desc(created), F.asc(ord)).limit(keep)


def keep_newest(sessions: DataFrame, owner, created: str, ord: str, keep: int = KEEP):
    """The newest ``keep`` of each owner; every map partition is cut before the shuffle."""
    w = W.partitionBy(*_list(owner)).orderBy(F.desc(created), F.asc(ord))
    numbered = sessions.withColumn("_n", F.row_number().over(w))
    return numbered.where(c("_n") <= max(0, keep)).drop("_n")


def prune_ids(sessions: DataFrame, owner, key: str, created: str, ord: str, keep: int = KEEP):
    """Everything past the newest ``keep`` of each owner.

    The kept rows are few, so they are found first and taken away by id: no owner's rows
    are ever ordered in one task as a whole.
    """
    owner = _list(owner)
    if keep <= 0:
        return sessions.select(*owner, key)
    columns = list(dict.fromkeys([*owner, key, created, ord]))
    kept = keep_newest(sessions.select(*columns), owner, created, ord, keep)
    ids = kept.select(*[c(x).alias(f"_k_{x}") for x in (*owner, key)])
    same = [c(x).eqNullSafe(c(f"_k_{x}")) for x in (*owner, key)]
    return sessions.select(*owner, key).join(ids, reduce(lambda a, b: a & b, same), "left_anti")


def lookup_session(sessions: DataFrame, key: str, value) -> DataFrame:
    return sessions.where(c(key) == F.lit(value))


def lookup_sessions(live: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Live records first, stored ones for the rest."""
    return live.unionByName(stored.join(live.select(key), key, "left_anti"))


def upsert_sessions(
    current: DataFrame, puts: DataFrame, key: str, owner, created: str, ord: str,
    keep: int = KEEP,
) -> DataFrame:
    """Put by id, the latest put of an id wins, then prune so the new rows count."""
    w = W.partitionBy(key).orderBy(F.desc(created), F.desc(ord))
    latest = puts.withColumn("_n", F.row_number().over(w)).where(c("_n") == 1).drop("_n")
    merged = current.join(latest.select(key), key, "left_anti").unionByName(latest)
    return keep_newest(merged, owner, created, ord, keep)


def delete_sessions(sessions: DataFrame, doomed: DataFrame | None, key: str) -> DataFrame:
    """Without the doomed ids; without any rows when ``doomed`` is None."""
    if doomed is None:
        return sessions.limit(0)
    return sessions.join(doomed.select(key), key, "left_anti")


def latest_only(entries: DataFrame, owner, saved: str, ord: str) -> DataFrame:
    """The last stashed record per owner; all others are evicted."""
    owner = _list(owner)
    rest = [x for x in entries.columns if x not in owner]
    best = F.max_by(F.struct(*rest), F.struct(saved, ord)).alias("_r")
    return entries.groupBy(*owner).agg(best).select(*owner, "_r.*")


def storage_report(sessions: DataFrame, size: str, keys: DataFrame, origin: str | None = None):
    """Counts and byte sums; a missing size counts as 0, an unknown total stays null."""
    total = F.max(origin) if origin else F.lit(None).cast("bigint")
    report = sessions.agg(
        F.count(F.lit(1)).alias("session_count"),
        F.coalesce(F.sum(F.coalesce(c(size), F.lit(0))), F.lit(0)).alias("session_bytes"),
        total.alias("origin_bytes"),
    )
    has = keys.agg((F.count(F.lit(1)) > 0).alias("has_keys"))
    return report.withColumn("has_keys", has.scalar())


def name_fallback(ids: DataFrame, live: DataFrame, crumbs: DataFrame, key: str) -> DataFrame:
    """Live name, else the breadcrumb, else null."""
    a = live.select(key, c("name").alias("_live"))
    b = crumbs.select(key, c("name").alias("_crumb"))
    joined = ids.join(a, key, "left").join(b, key, "left")
    return joined.withColumn("name", F.coalesce("_live", "_crumb")).drop("_live", "_crumb")


def peek_join(entries: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Stems and longest duration of each entry; an unreadable entry has nulls."""
    joined = entries.join(summaries, key, "left")
    failed = F.coalesce("failed", F.lit(True))
    ok = ~failed
    longest = F.when(c("duration_seconds") > 0, c("duration_seconds"))
    return joined.select(
        *entries.columns, F.when(ok, c("stems")).alias("stems"),
        F.when(ok, longest).alias("duration_seconds"), failed.alias("failed"),
    )
