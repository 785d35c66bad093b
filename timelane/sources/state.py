"""Saved mix state: JSON files and compact base64 strings, both ways.

Untrusted JSON is read as VARIANT, so every field is judged by the type it really has and
a bad field costs only itself. Nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelane.functions.bits import let
from timelane.functions.scalars import GAIN_MAX, GAIN_MIN, clamp, round_half_up
from timelane.operators.keyframes import SAME_TIME, is_finite

c = F.col

# Fixed values of the file format.
STATE_VERSION = 2
MIX_FORMAT = "awc-mix"
MIX_VERSION = 2
APP_VERSION = "0.1.0"
DEFAULT_RATE = 48000

# Fixed values of the settings record.
ACCENTS = ("tangerine", "amber", "lime", "cyan", "violet", "pink")
DEFAULTS = {
    "accent": "tangerine", "reduceMotion": False, "autoplayOnLoad": False,
    "defaultMasterPct": 100.0,
}
MASTER_PCT_MAX = 150.0


def strict_json(text: Column) -> Column:
    """The parsed text, or null unless all of it is one JSON value.

    Spark's parser stops behind the first value. What follows it shows when the text stands in
    a list and in an object: a second value, or a rest, breaks one of the two.
    """
    listed = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    named = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.when((F.size(listed) == 1) & named.isNotNull(), F.try_parse_json(text))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_number(v: Column) -> Column:
    kind = _kind(v)
    plain = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.coalesce(plain, F.lit(False))


def _number(v: Column) -> Column:
    return F.when(_is_number(v), F.try_variant_get(v, "$", "double"))


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _flag(v: Column) -> Column:
    return F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def _member(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def truthy(v: Column) -> Column:
    kind = _kind(v)
    empty = (
        (kind == "VOID") | (_flag(v) == False) | (_number(v) == 0) | (_text(v) == "")  # noqa: E712
    )
    return F.when(v.isNotNull(), ~F.coalesce(empty, F.lit(False))).otherwise(F.lit(False))


def _keyframe(items: Column, i: Column) -> Column:
    """Keyframe of the triple at ``i``; null unless time and gain are numbers."""

    def build(x):
        hold = F.coalesce(x["flag"] == 1, F.lit(False))
        ok = is_finite(x["time"]) & is_finite(x["gain"])
        return F.when(
            ok,
            F.struct(
                F.greatest(F.lit(0.0), x["time"]).alias("time"), x["at"].alias("ord"),
                clamp(x["gain"], GAIN_MIN, GAIN_MAX).alias("gain"),
                F.when(hold, "hold").otherwise("linear").alias("easing"),
            ),
        )

    triple = F.struct(
        i.alias("at"), (_number(F.get(items, i)) / 100).alias("time"),
        (_number(F.get(items, i + 1)) / 100).alias("gain"),
        _number(F.get(items, i + 2)).alias("flag"),
    )
    return let(triple, build)


def _last_of_equal_times(rows: Column) -> Column:
    return let(
        F.array_sort(rows),
        lambda a: F.filter(
            a,
            lambda x, i: (i == F.size(a) - 1)
            | (F.get(a, i + 1)["time"] - x["time"] >= SAME_TIME),
        ),
    )


def decode_entry(entry: Column) -> Column:
    """Keyframes of one pair from its flat list, and whether it was an old layout.

    Struct ``keyframes`` (null when there are none) in normal form and ``legacy``.
    """

    def build(x):
        items = x["items"]
        usable = (F.size(items) > 0) & ~x["legacy"]
        starts = F.sequence(F.lit(0), F.size(items) - 3, F.lit(3))
        rows = F.array_compact(F.transform(starts, lambda i: _keyframe(items, i)))
        found = F.when(usable, _last_of_equal_times(rows))
        return let(
            found,
            lambda k: F.struct(
                F.when(F.size(k) > 0, k).alias("keyframes"), x["legacy"].alias("legacy")
            ),
        )

    def judge(items):
        head = F.get(items, F.lit(0))
        old = ~_is_number(head) | (_number(head) == -1) | (F.size(items) % 3 != 0)
        legacy = F.coalesce((F.size(items) > 0) & old, F.lit(False))
        return let(F.struct(items.alias("items"), legacy.alias("legacy")), build)

    return let(F.try_variant_get(entry, "$", "array<variant>"), judge)


def decode_state(value: Column) -> Column:
    """Typed state from a parsed JSON value; null when the required fields are missing.

    ``m`` 0/1, ``g`` default 100, ``p`` default 0, ``master``, ``automation`` (per pair),
    ``legacy_dropped`` and ``legacy_v1`` (keyframes of an older meaning).
    """

    def fields(v):
        return F.struct(
            *[_member(v, n, "array<variant>").alias(n) for n in ("m", "g", "p")],
            _number(_member(v, "M")).alias("master"),
            F.coalesce(_number(_member(v, "v")), F.lit(1.0)).alias("version"),
            F.transform(_member(v, "a", "array<variant>"), decode_entry).alias("auto"),
        )

    def build(x):
        automated = F.exists(x["auto"], lambda e: e["keyframes"].isNotNull())
        dropped = F.exists(x["auto"], lambda e: e["legacy"])
        valid = x["m"].isNotNull() & x["g"].isNotNull() & x["p"].isNotNull()
        return F.when(
            valid & x["master"].isNotNull(),
            F.struct(
                F.transform(x["m"], lambda e: F.when(truthy(e), 1).otherwise(0)).alias("m"),
                F.transform(x["g"], lambda e: F.coalesce(_number(e), F.lit(100.0))).alias("g"),
                F.transform(x["p"], lambda e: F.coalesce(_number(e), F.lit(0.0))).alias("p"),
                x["master"].alias("master"),
                F.transform(x["auto"], lambda e: e["keyframes"]).alias("automation"),
                F.coalesce(dropped, F.lit(False)).alias("legacy_dropped"),
                F.coalesce((x["version"] < STATE_VERSION) & automated, F.lit(False)).alias(
                    "legacy_v1"
                ),
            ),
        )

    return let(value, lambda v: let(fields(v), build))


def read_compact_state(text: Column) -> Column:
    """State out of ``...s=<base64>`` or a bare payload; null on any failure."""
    named = F.regexp_extract(text, r"(?:^|[#&])s=([^&]+)", 1)
    payload = F.when(named != "", named).otherwise(text)
    padding = F.repeat(F.lit("="), F.pmod(4 - F.length(payload) % 4, F.lit(4)))
    raw = F.try_to_binary(F.concat(payload, padding), F.lit("base64"))
    return decode_state(strict_json(F.decode(raw, "ISO-8859-1")))


def encode_entry(keyframes: Column) -> Column:
    """Flat JSON list of a keyframe array, ``0`` without keyframes."""

    def triple(k):
        return F.concat_ws(
            ",",
            round_half_up(k["time"] * 100).cast("string"),
            round_half_up(k["gain"] * 100).cast("string"),
            F.when(k["easing"] == "hold", "1").otherwise("0"),
        )

    body = F.concat(F.lit("["), F.array_join(F.transform(keyframes, triple), ","), F.lit("]"))
    return F.when(F.size(keyframes) > 0, body).otherwise(F.lit("0"))


def _ints(values: Column) -> Column:
    return F.concat(
        F.lit("["),
        F.array_join(F.transform(values, lambda x: round_half_up(x).cast("string")), ","),
        F.lit("]"),
    )


def state_json(
    m: Column, g: Column, p: Column, master: Column, automation: Column | None = None
) -> Column:
    """The compact JSON text; automation is left out when no pair has keyframes."""
    parts = [
        F.lit(f'{{"v":{STATE_VERSION},"m":'), _ints(m), F.lit(',"g":'), _ints(g),
        F.lit(',"p":'), _ints(p), F.lit(',"M":'), round_half_up(master).cast("string"),
    ]
    if automation is not None:
        some = F.exists(automation, lambda k: F.size(k) > 0)
        body = F.array_join(F.transform(automation, encode_entry), ",")
        field = F.concat(F.lit(',"a":['), body, F.lit("]"))
        parts.append(F.when(F.coalesce(some, F.lit(False)), field).otherwise(F.lit("")))
    return F.concat(*parts, F.lit("}"))


def write_compact_state(json: Column) -> Column:
    encoded = F.regexp_replace(F.base64(F.encode(json, "UTF-8")), r"[\r\n]", "")
    return F.regexp_replace(encoded, "=+$", "")


def parse_mix_file(text: Column) -> Column:
    """One saved mix as a struct; ``error`` names the first failed check, else null.

    Errors: invalid_json, not_object, format, version_1, version, meta, state.
    """

    def default(col, value):
        return F.coalesce(col, F.lit(value))

    def fields(v):
        meta = _member(v, "awc")
        named = [
            _member(v, f"awc.{x}").isNotNull()
            for x in ("name", "size", "streamCount", "sampleRate")
        ]
        return F.struct(
            v.alias("v"), _kind(v).alias("kind"), meta.alias("meta"),
            default(_text(_member(v, "format")) == MIX_FORMAT, False).alias("format_ok"),
            _number(_member(v, "version")).alias("version"),
            (
                default(_kind(meta).startswith("OBJECT"), False)
                & (named[0] | named[1] | named[2] | named[3])
            ).alias("meta_ok"),
            decode_state(_member(v, "state")).alias("state"),
        )

    def build(x):
        meta = x["meta"]
        error = (
            F.when(x["kind"].isNull(), "invalid_json")
            .when(~x["kind"].startswith("OBJECT"), "not_object")
            .when(~x["format_ok"], "format")
            .when(default(x["version"] == 1, False), "version_1")
            .when(~default(x["version"] == MIX_VERSION, False), "version")
            .when(~x["meta_ok"], "meta")
            .when(x["state"].isNull(), "state")
        )
        size, streams = _number(_member(meta, "size")), _number(_member(meta, "streamCount"))
        rate = _number(_member(meta, "sampleRate"))
        return F.struct(
            error.alias("error"),
            default(_text(_member(meta, "name")), "").alias("name"),
            default(size, 0.0).cast("bigint").alias("size"),
            default(streams, 0.0).cast("bigint").alias("stream_count"),
            default(rate, float(DEFAULT_RATE)).cast("bigint").alias("sample_rate"),
            x["state"].alias("state"),
            default(_text(_member(x["v"], "savedAt")), "").alias("saved_at"),
            default(_text(_member(x["v"], "appVersion")), "unknown").alias("app_version"),
        )

    return let(strict_json(text), lambda v: let(fields(v), build))


def read_mix_files(spark, path: str, wholetext: bool = False) -> DataFrame:
    """Saved mixes of a folder, errors in a column.

    One row per line, the layout of :func:`write_mix_files`; with ``wholetext`` one row per file,
    for folders where every file is one text that may span lines.
    """
    files = spark.read.text(path, wholetext=wholetext).select(
        c("_metadata.file_path").alias("file"), c("value")
    )
    return files.select("file", parse_mix_file(c("value")).alias("mix")).select("file", "mix.*")


def mix_file_json(
    name: Column, size: Column, stream_count: Column, sample_rate: Column, state: Column,
    saved_at: Column,
) -> Column:
    """JSON text of a saved mix; ``state`` is the text of :func:`state_json`."""
    head = F.to_json(
        F.struct(
            F.lit(MIX_FORMAT).alias("format"), F.lit(MIX_VERSION).alias("version"),
            F.struct(
                name.alias("name"), size.alias("size"), stream_count.alias("streamCount"),
                sample_rate.alias("sampleRate"),
            ).alias("awc"),
        )
    )
    tail = F.to_json(
        F.struct(saved_at.alias("savedAt"), F.lit(APP_VERSION).alias("appVersion"))
    )
    return F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"state":'), state, F.lit(","),
        F.substring(tail, F.lit(2), F.length(tail)),
    )


def write_mix_files(texts: DataFrame, path: str) -> None:
    """One JSON text per line, in as many files as there are partitions; an existing folder is
    replaced."""
    texts.select("value").write.mode("overwrite").text(path)


def apply_mix(mixes: DataFrame, pairs: DataFrame, key: str = "mix") -> DataFrame:
    """Saved settings for the pairs that exist now.

    ``mixes``: key, stream_count, state (struct of :func:`decode_state`). ``pairs``: key,
    pair (from 1), left_track, right_track. Pairs past the saved ones keep no row.
    """
    counted = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("pair_count"))
    saved = mixes.join(counted, key).select(
        key, c("state.g").alias("_g"), c("state.p").alias("_p"),
        "pair_count", F.posexplode("state.m").alias("_n", "_m"),
    )
    n = c("_n")
    settings = saved.where(n < c("pair_count")).select(
        key, (n + 1).cast("bigint").alias("pair"), (c("_m") == 1).alias("enabled"),
        (F.coalesce(F.get("_g", n), F.lit(100.0)) / 100).alias("gain"),
        F.abs(F.coalesce(F.get("_p", n), F.lit(100.0)) / 100).alias("spread"),
    )
    return pairs.join(settings, [key, "pair"])


def apply_warnings(mixes: DataFrame, pairs: DataFrame, key: str = "mix") -> DataFrame:
    """``pair_mismatch``, ``stream_mismatch`` or null per mix."""
    counted = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("pair_count"))
    saved = F.size("state.m")
    expected = F.ceil(c("stream_count") / 2)
    warning = F.when(saved != c("pair_count"), "pair_mismatch").when(
        expected != c("pair_count"), "stream_mismatch"
    )
    return mixes.join(counted, key).select(key, warning.alias("warning"))


def loaded_wrong_file(saved_name: Column, loaded_name: Column) -> Column:
    return F.coalesce((saved_name != "") & (saved_name != loaded_name), F.lit(False))


def settings_with_defaults(text: Column) -> Column:
    """Settings record; each field is judged alone and falls back to its default."""

    def build(v):
        accent = _text(_member(v, "accent"))
        pct = _number(_member(v, "defaultMasterPct"))
        return F.struct(
            F.coalesce(F.when(accent.isin(*ACCENTS), accent), F.lit(DEFAULTS["accent"])).alias(
                "accent"
            ),
            *[
                F.coalesce(_flag(_member(v, x)), F.lit(DEFAULTS[x])).alias(x)
                for x in ("reduceMotion", "autoplayOnLoad")
            ],
            F.coalesce(
                F.when((pct >= 0) & (pct <= MASTER_PCT_MAX), pct),
                F.lit(DEFAULTS["defaultMasterPct"]),
            ).alias("defaultMasterPct"),
        )

    return let(strict_json(text), build)


def patch_settings(current: Column, patch: Column, fields=tuple(DEFAULTS)) -> Column:
    """Shallow merge of two records; null patch fields keep the value."""
    return F.struct(*[F.coalesce(patch[x], current[x]).alias(x) for x in fields])
