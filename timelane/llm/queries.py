"""The numbered operators over the given tables; each query maps names and derives digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelane.llm.alignment import align_tokens
from timelane.llm.contamination import benchmark_windows, word_counts
from timelane.llm.cross_entropy import cross_entropy_difference
from timelane.llm.id_files import read_id_files, write_id_files
from timelane.llm.main_text import default_model, extract_main_text
from timelane.llm.near_duplicates import near_duplicate_sets
from timelane.llm.packing import best_fit_windows, cut_windows
from timelane.llm.quality_model import fit_discriminant, score_quality, text_statistics
from timelane.llm.quality_rules import adaptive_limits, judge, measure_texts, quantile_sketches
from timelane.llm.repeated_passages import remove_repeated
from timelane.llm.revisits import resolve_revisits
from timelane.llm.store import scratch_path, stored
from timelane.llm.token_counts import count_tokens
from timelane.llm.whitening import whiten_windows

c = F.col
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
MOST_TOKENS = 4096

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` with their places, and a checksum in place of the ids."""
    pieces = cut_windows(docs, public_tokenizers.path(VOCABULARY), key="doc_id")
    digest = pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
        c("total").alias("doc_tokens"),
    )
    return best_fit_windows(digest, key="doc_id")


@query("op10_best_fit_packing")
def _(spark, folder):
    return packed(read(spark, folder, "documents"))


_SLACK = "6000 / sqrt(greatest(n_words, 1))"



def _quartiles_sql(name: str, by: str) -> str:
    return f"""{name}_n as (select {by}rule, bin, sum(count(*)) over (partition by {by}rule order by bin) as upto,
        sum(count(*)) over (partition by {by}rule) as n from long group by {by}rule, bin),
    {name} as (select {by}rule, max(n) as n, [min(bin) filter (upto * 4 >= n),
        min(bin) filter (upto * 4 >= n * 2), min(bin) filter (upto * 4 >= n * 3)] as q
        from {name}_n group by {by}rule)"""


RULES_SQL = f"""with t as (select doc_id, lang, source, coalesce(text, '') as t from documents),
    w as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
        list_filter(string_split(t, chr(10)),
            lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from t),
    g as (select doc_id, i, array_to_string(ws[i : i + 4], ' ') as g
        from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
    twice as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
    rep as (select doc_id, count(distinct i + k) as n_repeat_words
        from twice, (select unnest(range(5)) as k) group by doc_id),
    m as (select w.doc_id, lang, source, len(ws)::bigint as n_words,
        length(array_to_string(ws, ''))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join rep using (doc_id)),
    f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
        case when n_words > 0 then 1000 * n_symbols // n_words else 0 end as symbols,
        case when n_lines > 0 then 1000 * n_dup_lines // n_lines else 0 end as lines,
        case when n_words > 0 then 1000 * word_chars // n_words else 0 end as length_ from m),
    long as (select lang, source, rule, (v >> d) << d as bin from (
        select *, greatest(len(bin(v)) - 7, 0)::bigint as d from (
        select lang, source, 'symbols' as rule, symbols as v from f where not base_failed
        union all select lang, source, 'lines', lines from f where not base_failed
        union all select lang, source, 'length', length_ from f where not base_failed))),
    {_quartiles_sql('q0', 'lang, source, ')},
    {_quartiles_sql('q1', 'lang, ')},
    {_quartiles_sql('q2', '')},
    chosen as (select q0.lang, q0.source, q0.rule,
        case when q0.n >= 200 then q0.q when q1.n >= 200 then q1.q else q2.q end as q from q0
        join q1 on q0.lang is not distinct from q1.lang and q0.rule = q1.rule
        join q2 on q0.rule = q2.rule),
    lim as (select lang, source,
        max(case when rule = 'symbols' then q[2] + greatest(4 * (q[3] - q[1]), 100) end) as s_high,
        max(case when rule = 'lines' then q[2] + greatest(4 * (q[3] - q[1]), 400) end) as l_high,
        max(case when rule = 'length' then q[2] + greatest(4 * (q[3] - q[1]), 500) end) as n_high,
        max(case when rule = 'length' then q[2] - greatest(4 * (q[3] - q[1]), 500) end) as n_low
        from chosen group by all)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and coalesce(symbols <= s_high and lines <= l_high
            and length_ <= n_high + {_SLACK} and length_ >= n_low - {_SLACK}, false) as kept
    from f left join lim on f.lang is not distinct from lim.lang
        and f.source is not distinct from lim.source"""


@query("op9_quality_rules", RULES_SQL)
def _(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    counts = [c(f"measures.{n}") for n in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    measured = stored(measure_texts(docs).drop("text"))
    limits = adaptive_limits(quantile_sketches(measured))
    return judge(measured, limits).select("doc_id", *counts, "base_failed", "kept")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

CONTAMINATION_SQL = f"""with d as (select doc_id, {_ALNUM} as ws from documents),
    i as (select item_id, ws, least(len(ws), 13) as n from (select item_id, {_ALNUM} as ws from benchmark)
        where len(ws) > 0),
    iw as (select distinct item_id, n, array_to_string(ws[k : k + n - 1], ' ') as w
        from (select *, unnest(range(1, len(ws) - n + 2)) as k from i)),
    dw as (select doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') as w
        from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as k
            from d, (select distinct n from i) where len(ws) >= n)),
    hit as (select doc_id, dw.n, k, item_id from dw join iw on dw.w = iw.w and dw.n = iw.n),
    covered as (select doc_id, count(distinct k + j) as n_hit
        from (select distinct doc_id, n, k from hit), (select unnest(range(13)) as j) where j < n
        group by doc_id),
    named as (select doc_id, count(distinct item_id) as n_items,
        string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from hit group by doc_id)
    select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
        coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
        coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
    from d left join covered using (doc_id) left join named using (doc_id)"""


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: words, words hit, items found, and the verdict."""
    hits = benchmark_windows(docs, items, key="doc_id")
    per_doc = hits.groupBy(c("doc_id").alias("_doc")).agg(
        F.collect_set(F.struct("first", "size")).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["first"], s["first"] + s["size"] - 1)))))
    joined = word_counts(docs, key="doc_id").join(per_doc, c("doc_id") == c("_doc"), "left")
    n_hit = F.coalesce(covered, F.lit(0)).cast("bigint")
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= c("n_words"))).alias("contaminated"),
    )


@query("op5_benchmark_contamination", CONTAMINATION_SQL)
def _(spark, folder):
    return contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op3_near_duplicates")
def _(spark, folder):
    return near_duplicate_sets(read(spark, folder, "documents"), key="doc_id", shingle=2)


_SPACED = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

PASSAGES_SQL = f"""with d as (select doc_id, {_SPACED} as ws from documents),
    w as (select doc_id, k, array_to_string(ws[k : k + 49], ' ') as w
        from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as k from d)),
    first as (select md5(w) as h, min(doc_id) as low from w group by md5(w)),
    hit as (select distinct doc_id, k + j as i from w join first on md5(w.w) = h and doc_id > low,
        (select unnest(range(50)) as j)),
    kept as (select doc_id, string_agg(word, ' ' order by i) as kept, count(*) as n from
        (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from d) anti join hit
        using (doc_id, i) group by doc_id)
    select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed,
        sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (doc_id)"""


@query("op4_repeated_passages", PASSAGES_SQL)
def _(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    left = remove_repeated(docs, key="doc_id")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return left.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))


GOOD_FROM = 0.3


@query("op6_quadratic_discriminant")
def _(spark, folder):
    held_out = F.pmod(F.crc32(c("doc_id").cast("string")), F.lit(5)) == 0
    statistics = stored(text_statistics(read(spark, folder, "documents"), key="doc_id"))
    labels = read(spark, folder, "labels").select("doc_id", "quality").distinct()
    model = fit_discriminant(statistics.where(~held_out).join(labels, "doc_id"))
    return score_quality(statistics, model, key="doc_id").select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (c("score") >= GOOD_FROM).cast("int").alias("predicted"))


def captures(pages: DataFrame) -> DataFrame:
    """Two captures of every page: its response, and a not-modified answer at another time."""
    at = c("page_id") * 10
    later = F.when(c("page_id") % 10 == 0, at - 5).otherwise(at + 20_000)
    common = {"etag": F.substring(F.md5("html"), 1, 16), "last_modified": F.lit(None).cast("string")}
    def headers(**kw):
        return F.create_map(*[x for k, v in kw.items() for x in (F.lit(k.replace("_", "-")), v)])

    size = F.char_length("html").cast("string")
    first = pages.select(
        (c("page_id") * 2).alias("record_id"), "url", at.alias("time"), F.lit(False).alias("revisit"),
        common["etag"].alias("etag"), common["last_modified"].alias("last_modified"),
        headers(Content_Type=F.lit("text/html"), Content_Length=size, Date=at.cast("string")).alias("headers"))
    again = pages.select(
        (c("page_id") * 2 + 1).alias("record_id"), "url", later.alias("time"), F.lit(True).alias("revisit"),
        F.when(c("page_id") % 7 != 0, F.concat(F.when(c("page_id") % 3 == 0, "W/").otherwise(""), common["etag"]))
        .alias("etag"), common["last_modified"].alias("last_modified"),
        headers(Content_Length=F.lit("0"), Date=later.cast("string"), Age=F.lit("1")).alias("headers"))
    return first.unionByName(again)


REVISITS_SQL = r"""with u as (select page_id, html, trim(url) as url,
        regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') as w from pages),
    k as (select *, regexp_replace(lower(regexp_extract(w, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g')
        || regexp_replace(regexp_extract(w, '^[^/?]*([^?]*)', 1), '/+$', '') as base,
        list_sort(list_filter(string_split(regexp_extract(w, '\?(.*)$', 1), '&'), lambda p: p <> ''
            and not regexp_matches(lower(p), '^(utm_[a-z]+|ref|sid|sessionid|phpsessid|jsessionid|gclid|fbclid)='))) as q
        from u),
    p as (select page_id, case when url <> '' then base
        || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end end as canonical,
        md5(html)[1:16] as etag, length(html) as size, page_id * 10 as at,
        case when page_id % 10 = 0 then page_id * 10 - 5 else page_id * 10 + 20000 end as later from k),
    a as (select r.page_id, r.canonical, r.later, f.page_id as target,
            case when r.page_id % 7 <> 0 then r.etag end as mine, f.etag as theirs, f.size, f.at,
            row_number() over (partition by r.page_id order by f.at desc nulls last, f.page_id desc) as rn
        from p r left join p f on r.canonical = f.canonical and f.at < r.later)
    select page_id * 2 + 1 as record_id, canonical, target * 2 as target_id, status,
        case when status = 'resolved' then 'age=1,content-length=' || size || ',content-type=text/html,date=' || later
            end as headers
    from (select *, case when canonical is null then 'no_url' when target is null then 'no_response'
        when mine = theirs then 'resolved' when mine <> theirs then 'etag_differs'
        else 'no_validator' end as status from a where rn = 1)"""


@query("op1_revisit_resolution", REVISITS_SQL)
def _(spark, folder):
    solved = resolve_revisits(captures(read(spark, folder, "pages")))
    text = F.array_join(F.sort_array(F.transform(
        F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return solved.withColumn("headers", text)


@query("op2_cross_entropy_difference")
def _(spark, folder):
    good = read(spark, folder, "labels").where("quality = 1")
    return cross_entropy_difference(read(spark, folder, "documents"), good, key="doc_id")


@query("op7_tree_model_text")
def _(spark, folder):
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    return extract_main_text(pages, default_model(spark)).select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op8_id_files")
def _(spark, folder):
    path = scratch_path(spark)
    write_id_files(read(spark, folder, "documents"), path, public_tokenizers.path(VOCABULARY), key="doc_id")
    return read_id_files(spark, path, key="doc_id").select(
        "doc_id", "start", c("length").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op11_token_alignment")
def _(spark, folder):
    paths = (public_tokenizers.path(name) for name in (VOCABULARY, PIECES))
    aligned = align_tokens(read(spark, folder, "documents"), *paths, key="doc_id")
    digest = F.when(c("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.withColumn("groups_sha256", digest).drop("groups")


@query("op12_token_counts")
def _(spark, folder):
    counts = count_tokens(read(spark, folder, "documents"), public_tokenizers.path(PIECES), key="doc_id")
    return counts.withColumn("over_limit", c("n_tokens") > MOST_TOKENS)


@query("op13_whitening")
def _(spark, folder):
    return whiten_windows(read(spark, folder, "embeddings"), keys="vec_id", values="embedding")
