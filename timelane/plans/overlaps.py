"""Byte windows shared by documents and benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from timelane.operators.overlap import shared_windows, window_hash_search
from timelane.plans.registry import query


WINDOWS_SQL = """d as (select doc_id, hex(encode(text)) as h, octet_length(encode(text)) as n from documents),
    b as (select item_id, hex(encode(text)) as h, octet_length(encode(text)) as n from benchmark),
    scan as (select doc_id, o as "offset", h[2 * o + 1 : 2 * o + 64] as w
        from (select doc_id, h, unnest(range(0, n - 31, 8)) as o from d)),
    target as (select distinct item_id, h[2 * o + 1 : 2 * o + 64] as w
        from (select item_id, h, unnest(range(0, n - 31)) as o from b))"""


@query(
    "window_hash_search",
    f"""with {WINDOWS_SQL},
    hits as (select s.doc_id, t.item_id, s.w, min(s."offset") as "offset" from scan s
        join target t on s.w = t.w group by all)
    select doc_id, item_id, min("offset") as first_offset, count(*) as windows from hits group by all""",
)
def _(t):
    return window_hash_search(
        t.documents, t.benchmark, scan_key="doc_id", target_key="item_id"
    )


CLASSES_SQL = f"""{WINDOWS_SQL},
    held as (select doc_id, w, min("offset") as "offset" from scan where w in (select w from target) group by all),
    classes as (select w, count(*) as scans, min(doc_id) as first_scan from held group by w),
    named as (select w, count(*) as targets, min(item_id) as first_target from target group by w)"""


@query(
    "window_classes",
    f"""with {CLASSES_SQL} select w as "window", scans, targets, first_scan, first_target
    from classes join named using (w)""",
)
def _(t):
    classes, _ = shared_windows(t.documents, t.benchmark, scan_key="doc_id", target_key="item_id")
    return classes.withColumn("window", F.hex("window"))


@query("window_members", f"""with {CLASSES_SQL} select doc_id, w as "window", "offset" from held""")
def _(t):
    _, members = shared_windows(t.documents, t.benchmark, scan_key="doc_id", target_key="item_id")
    return members.withColumn("window", F.hex("window"))
