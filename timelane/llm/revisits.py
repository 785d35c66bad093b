"""Not-modified revisits of a web archive, resolved to the responses that they confirm.

The library has no records of web captures, so this works on any table of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timelane.llm.store import stored

c = F.col

SLICES = 64
"""The time line is cut at so many quantiles; one URL's captures are ordered slice by slice."""

# Query parameters that name a visit and not a page, and header fields that a
# not-modified answer may not change (RFC 9111, section 3.2) or that hold for one connection.
VISIT_PARAMETERS = "^(utm_[a-z]+|ref|sid|sessionid|phpsessid|jsessionid|gclid|fbclid)="
KEPT_HEADERS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer",
    "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """Host and path that captures of one page share; null for null or empty.

    Scheme, a leading ``www.``, default port, fragment, slashes at the end of the path and
    visit parameters go; the host is lower-cased; other parameters are sorted.
    """
    whole = F.regexp_replace(F.regexp_replace(F.btrim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(whole, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(whole, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(
        F.split(F.regexp_extract(whole, r"\?(.*)$", 1), "&"),
        lambda p: (p != "") & ~F.lower(p).rlike(VISIT_PARAMETERS),
    )
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.sort_array(query), "&"))).otherwise("")
    return F.when(F.btrim(url) != "", F.concat(host, path, tail))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """For each revisit, the latest earlier full response of its canonical URL.

    ``captures``: ``record_id`` (whole number), ``url``, ``time`` (whole number), ``revisit``
    (boolean; false is a full response), ``etag``, ``last_modified`` (strings or null) and
    ``headers`` (map of strings). Other columns are left out. Earlier means by time, then by
    record id.

    Rows, one per revisit: ``record_id``, ``canonical``, ``target_id`` (null without one),
    ``status`` and ``headers``. The status is ``resolved``; ``no_url`` or ``no_time`` (null or
    empty); ``no_response`` (none is earlier); ``etag_differs``, ``date_differs`` or
    ``no_validator``: entity tags decide if both records have one, else the dates of
    modification. ``headers`` (names lower-cased) of a resolved revisit are the response's,
    with the permitted ones of the revisit on top; else they are null. A null ``revisit`` counts
    as a full response, which needs a URL and a time to be found. Repeated rows are answered each.
    """
    spark = captures.sparkSession
    rows = stored(captures.select(
        c("record_id").cast("bigint"), canonical_url(c("url")).alias("canonical"), c("time").cast("bigint"),
        F.coalesce("revisit", F.lit(False)).alias("revisit"), "etag", "last_modified",
        F.transform_keys("headers", lambda k, v: F.lower(k)).alias("headers"),
    ))
    placed = rows.where("canonical is not null and time is not null")
    cuts = placed.agg(F.percentile_approx("time", [i / SLICES for i in range(1, SLICES)], 10_000)).first()[0]
    edges = F.array(*[F.lit(int(x)) for x in sorted(set(cuts or []))]).cast("array<bigint>")
    narrow = placed.select(
        "canonical", "time", "record_id", "revisit",
        F.size(F.filter(edges, lambda e: e < c("time"))).alias("slice"),
        F.when(~c("revisit"), F.struct("time", "record_id")).alias("full"),
    )
    # Last response of each slice, and of all slices before one: at most SLICES rows a URL.
    lasts = narrow.groupBy("canonical", "slice").agg(F.max("full").alias("last"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        c("canonical").alias("_c"), c("slice").alias("_s"), F.max("last").over(before)["record_id"].alias("carried"))
    inside = Window.partitionBy("canonical", "slice").orderBy("time", "record_id", "revisit").rowsBetween(
        Window.unboundedPreceding, -1)
    found = (
        narrow.withColumn("own", F.last("full", ignorenulls=True).over(inside)["record_id"])
        .where("revisit")
        .join(carried, (c("canonical") == c("_c")) & (c("slice") == c("_s")))
        .select(c("record_id").alias("_id"), c("time").alias("_t"), c("canonical").alias("_u"),
                F.coalesce("own", "carried").alias("target_id"))
        .distinct()
    )
    # Of responses with one id and URL the earliest counts, of these the one with the least validators.
    first = F.struct("time", "etag", "last_modified")
    full = rows.where("not revisit").groupBy(c("record_id").alias("_full"), c("canonical").alias("_of")).agg(
        F.min_by(F.struct("etag", "last_modified", "headers"), first).alias("full"))
    asked = rows.where("revisit").join(
        found, (c("record_id") == c("_id")) & (c("time") == c("_t")) & (c("canonical") == c("_u")), "left")
    joined = asked.join(full, (c("target_id") == c("_full")) & (c("canonical") == c("_of")), "left")
    mine, theirs = (F.regexp_replace(x, "^W/", "") for x in ("etag", "full.etag"))  # compared weakly
    status = (
        F.when(c("canonical").isNull(), "no_url").when(c("time").isNull(), "no_time")
        .when(c("target_id").isNull(), "no_response")
        .when(mine == theirs, "resolved").when(mine != theirs, "etag_differs")
        .when(c("last_modified") == c("full.last_modified"), "resolved")
        .when(c("last_modified") != c("full.last_modified"), "date_differs")
        .otherwise("no_validator")
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    fresh = F.map_filter(F.coalesce("headers", empty), lambda k, v: ~k.isin(KEPT_HEADERS))
    stale = F.map_filter(F.coalesce("full.headers", empty), lambda k, v: ~F.map_contains_key(fresh, k))
    return joined.withColumn("status", status).select(
        "record_id", "canonical", "target_id", "status",
        F.when(c("status") == "resolved", F.map_concat(stale, fresh)).alias("headers"))
