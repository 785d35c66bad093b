"""Offsets, labels and summaries of catalogued streams and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelane.functions.scalars import jenkins29
from timelane.functions.text import strip_extension
from timelane.operators.ordered import Ordered, biggest, lists_per_key, ordered

c = F.col


def _list(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def prefix_offsets(df: DataFrame, keys, order, size: Column, name: str) -> DataFrame:
    """Sum of the sizes before each row."""
    return ordered(df, keys, order).scan(before={name: size}).df


def renumber_rows(df: DataFrame, keys, order, name: str) -> DataFrame:
    """Position from 0."""
    numbered = ordered(df, keys, order).scan(number="_n").df
    return numbered.withColumn(name, c("_n") - 1).drop("_n")


def global_rank(df: DataFrame, order, name: str, **columns: Column) -> DataFrame:
    """Position from 1 over the whole table. A large table is cut along the order first,
    so no task orders all of it."""
    rows = df.withColumns({**columns, "_all": F.lit(0)})
    return ordered(rows, "_all", order).scan(number=name).df.drop("_all", *columns)


def frames_in_order(frames: DataFrame, keys, order) -> Ordered:
    """First sample and number of each frame, still ordered."""
    out = ordered(frames, keys, order).scan(before={"sample_offset": c("sample_count")}, number="_n")
    return out.map(lambda d: d.withColumn("number", c("_n") - 1).drop("_n"))


def frame_offsets(frames: DataFrame, keys, order) -> DataFrame:
    return frames_in_order(frames, keys, order).df


def block_output_offsets(blocks: DataFrame, keys, order) -> DataFrame:
    """Write position and kept samples of each block; a negative remainder keeps none."""
    kept = F.greatest(c("sample_count") - c("discard"), F.lit(0))
    return ordered(blocks.withColumn("kept", kept), keys, order).scan(before={"cursor": c("kept")}).df


def frame_at_sample(frames: Ordered, probes: DataFrame, keys) -> DataFrame:
    """Start of the frame that holds ``sample``; -1 past the end.

    A sample on a border belongs to the later frame. Frames and probes are sorted together
    once; empty frames never hold a sample.
    """
    keys = _list(keys)
    f = frames.df.where(c("sample_count") > 0).select(
        *keys, c("sample_offset").alias("_t"), F.lit(0).alias("_kind"),
        F.struct(c("sample_offset").alias("start"), c("sample_count").alias("n")).alias("_frame"),
    )
    p = probes.select(
        *keys, c("sample").alias("_t"), F.lit(1).alias("_kind"),
        F.struct(*[c(x) for x in probes.columns]).alias("_row"),
    )
    both = f.unionByName(p, allowMissingColumns=True)
    bound = frames.top + biggest(probes, keys)
    found = ordered(both, keys, ["_t", "_kind"], bound=bound).scan(fill={"_f": c("_frame")}).df
    x = c("_f")
    inside = c("_t") < x["start"] + x["n"]
    start = F.when(F.coalesce(inside, F.lit(False)), x["start"]).otherwise(F.lit(-1))
    return found.where(c("_kind") == 1).select("_row.*", start.cast("bigint").alias("frame_start"))


def join_format_data(formats: DataFrame, data: DataFrame, keys) -> DataFrame:
    """Streams that own both."""
    return formats.join(data, _list(keys))


def resolve_labels(
    streams: DataFrame, key: str, name: str, suffix: str = ".awc"
) -> DataFrame:
    """Pair and side of streams whose hash is that of ``<base>_<n>_<left|right>``.

    ``streams``: key, name (the file's), idx, hash. Candidates are generated per file, two
    per pair, and meet the streams in an equi-join on (file, hash); no cross product.
    """
    files = streams.groupBy(key).agg(F.first(name).alias("_name"), F.count(F.lit(1)).alias("_n"))
    base = strip_extension(c("_name"), suffix)
    pairs = files.select(
        key, base.alias("_base"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(c("_n") / 2))).alias("pair"),
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit("left").alias("word"), F.lit("L").alias("side")),
            F.struct(F.lit("right").alias("word"), F.lit("R").alias("side")),
        )
    )
    made = pairs.select(key, "_base", "pair", sides.alias("s"))
    text = F.concat_ws("_", "_base", c("pair").cast("string"), "s.word")
    short = F.concat_ws(" ", c("pair").cast("string"), F.upper("s.word"))
    candidates = made.select(
        key, jenkins29(text).alias("hash"), "pair", c("s.side").alias("side"), short.alias("label")
    )
    # Two candidates with one hash: the later pair wins, right after left.
    best = candidates.groupBy(key, "hash").agg(
        F.max_by(F.struct("pair", "side", "label"), F.struct("pair", "side")).alias("b")
    )
    return streams.join(best.select(key, "hash", "b.*"), [key, "hash"], "left")


def codec_breakdown(streams: DataFrame, key: str) -> DataFrame:
    """``n × CODEC`` in first-seen order, joined with ``+``: one row per file."""
    counts = streams.groupBy(key, F.upper("codec").alias("codec")).agg(
        F.count(F.lit(1)).alias("_count"), F.min("idx").alias("_first")
    )
    item = F.concat(c("_count").cast("string"), F.lit(" × "), c("codec"))
    listed = lists_per_key(counts, key, "_first", item, "codecs")
    return listed.select(key, F.array_join("codecs", " + ").alias("breakdown"))


def file_summary(streams: DataFrame, key: str) -> DataFrame:
    """Stem count, longest duration, first stream's rate, encryption and layout counts."""
    longest = F.greatest(F.lit(0.0), F.coalesce(F.max("duration_seconds"), F.lit(0.0)))
    return streams.groupBy(key).agg(
        F.count(F.lit(1)).alias("stems"), longest.alias("duration_seconds"),
        F.min_by("sample_rate", "idx").alias("sample_rate"),
        F.bool_or("encrypted").alias("encrypted"), F.count("block_count").alias("block_streams"),
    )


def failure_report(failures: DataFrame) -> DataFrame:
    """Failures, first and last stream index of each message."""
    return failures.groupBy("message").agg(
        F.count(F.lit(1)).alias("failures"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


def failed_streams(failures: DataFrame) -> DataFrame:
    """Every failure with its place, from 0, among those of its message."""
    return ordered(failures.select("message", "idx"), "message", "idx").scan(number="_n").df.select(
        "message", (c("_n") - 1).alias("position"), "idx"
    )


def decode_progress(stems: DataFrame, key: str) -> DataFrame:
    """Blocks done of all blocks; a finished or failed stem counts in full."""
    whole = F.greatest(c("blocks"), F.lit(1))
    done = F.when(c("finished"), whole).otherwise(F.least(c("blocks_done"), whole))
    sums = stems.groupBy(key).agg(F.sum(whole).alias("total"), F.sum(done).alias("done"))
    return sums.withColumn("percent", F.floor(100.0 * c("done") / c("total") + 0.5))


def block_reconcile(blocks: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Samples that the blocks keep against the declared count."""
    got = blocks.groupBy(key).agg(F.sum(c("sample_count") - c("discard")).alias("_got"))
    samples = F.coalesce("_got", F.lit(0)).cast("bigint")
    return declared.join(got, key, "left").select(
        key, "declared", samples.alias("samples"), (samples - c("declared")).alias("diff")
    )
