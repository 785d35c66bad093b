"""Rules on the shape of a text, with limits that each language and source sets itself.

Everything here is DataFrame functions. A text is measured inside its own row; the sketches
are counts per bin, so they are summed before any shuffle and merge into coarser ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timelane.llm.store import stored

c = F.col

GRAM = 5
LEAST_WORDS = 10
REPEATED_PERCENT = 20
LEAST_ROWS = 200
"""A group with fewer measured texts takes the limits of its language, or of all texts."""

# Fixed values of the limits, in thousandths: how many spreads (upper less lower quartile)
# beyond the median are allowed, the least distance, and what short texts get on top
# (divided by the square root of the words).
RULES = {
    "symbols": {"spreads": 4, "least": 100, "short": 0, "low": False},
    "lines": {"spreads": 4, "least": 400, "short": 0, "low": False},
    "length": {"spreads": 4, "least": 500, "short": 6000, "low": True},
}

WHITE = " \t\n\x0b\f\r"
_WHITE_RUN = r"[\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where lambdas read it."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in a window of GRAM words which the text has twice or more."""

    def marked(grams):
        at = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(p):
            twice = F.filter(
                p,
                lambda x, k: F.coalesce(x["g"] == F.get(p, k - 1)["g"], F.lit(False))
                | F.coalesce(x["g"] == F.get(p, k + 1)["g"], F.lit(False)),
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def covered(s):
            steps = F.transform(
                s, lambda x, k: F.least(F.lit(GRAM), F.coalesce(F.get(s, k + 1) - x, F.lit(GRAM)))
            )
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _let(_let(at, places), covered)

    def count(h):
        grams = F.transform(
            F.sequence(F.lit(0), F.size(h) - GRAM),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(GRAM)]),
        )
        return F.when(F.size(h) < GRAM, 0).otherwise(
            _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(marked(g)))
        )

    return _let(F.transform(words, lambda w: F.xxhash64(w)), count)


def _measures(text: Column) -> Column:
    """A struct of all counts of one text."""
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, _WHITE_RUN)
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")

    def both(w):
        return _let(lines, lambda ls: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
            _repeated(w).cast("bigint").alias("n_repeat_words"),
            F.size(ls).cast("bigint").alias("n_lines"),
        ))

    return _let(words, both)


def measure_texts(records: DataFrame, *, text: str = "text") -> DataFrame:
    """Add the struct ``measures`` to saved mix files or any table with a text.

    Its fields (long): ``n_words`` (runs of characters other than ASCII white space),
    ``word_chars`` (code points in words), ``n_symbols``, ``n_lines`` (lines with a word),
    ``n_dup_lines`` (of these, equal to an earlier one), ``n_repeat_words`` (in windows of five
    words that the text has twice or more). A null or empty text has zeros. Rows stay as they are,
    equal ones too; a column named ``measures`` is replaced.
    """
    whole = F.coalesce(c(f"`{text}`").cast("string"), F.lit(""))
    return records.withColumn("measures", _let(whole, _measures))


def base_failed(m: Column) -> Column:
    """Too few words, or too many in repeated windows."""
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEATED_PERCENT * m["n_words"])


def _thousandths(m: Column) -> dict[str, Column]:
    """The measures that get limits, as whole thousandths."""
    def share(a, b):
        return F.when(m[b] > 0, F.floor(1000 * m[a] / m[b])).otherwise(0).cast("bigint")

    return {
        "symbols": share("n_symbols", "n_words"),
        "lines": share("n_dup_lines", "n_lines"),
        "length": share("word_chars", "n_words"),
    }


def _bin(x: Column) -> Column:
    """``x`` with its seven highest bits: bins at most 1/64 wide, few for any range."""
    drop = F.greatest(F.length(F.bin(x)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def quantile_sketches(measured: DataFrame, groups: Sequence[str] = ("lang", "source")) -> DataFrame:
    """Count texts per group, measure and bin, over the texts that pass the base rules.

    Rows: the groups (null is a group), ``rule``, ``bin``, ``n``. Sketches of two tables merge
    by adding ``n``.
    """
    values = _thousandths(c("measures"))
    stack = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), _bin(v).alias("bin")) for name, v in values.items()
    ])).alias("_s")
    return (
        measured.where(~base_failed(c("measures")))
        .select(*[c(f"`{g}`").cast("string").alias(f"_g{i}") for i, g in enumerate(groups)], stack)
        .groupBy(*[f"_g{i}" for i in range(len(groups))], c("_s.rule").alias("rule"), c("_s.bin").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def adaptive_limits(sketches: DataFrame, groups: int = 2) -> DataFrame:
    """Lowest and highest value of each rule for every group of ``quantile_sketches``.

    Groups with fewer than LEAST_ROWS texts take the limits of the merged sketch of their
    first group column, and those with still fewer of all texts. One row per group.
    """
    keys = [f"_g{i}" for i in range(groups)]

    def quantiles(by, level):
        own = Window.partitionBy(*by, "rule")
        below = sketches.groupBy(*by, "rule", "bin").agg(F.sum("n").alias("n"))
        below = below.select(
            *by, "rule", "bin", F.sum("n").over(own.orderBy("bin")).alias("upto"),
            F.sum("n").over(own).alias("rows"),
        )
        return below.groupBy(*[c(k).alias(f"{k}_{level}") for k in by], "rule").agg(
            F.max("rows").alias(f"rows{level}"),
            F.struct(*[
                F.min(F.when(c("upto") * 4 >= c("rows") * q, c("bin"))).alias(f"q{q}") for q in (1, 2, 3)
            ]).alias(f"at{level}"),
        )

    levels = [(keys, 0), (keys[:1], 1), ([], 2)] if groups > 1 else [(keys, 0), ([], 2)]
    out = None
    for by, level in levels:
        q = quantiles(by, level).withColumnRenamed("rule", f"rule{level}")
        if out is None:
            out = q
            continue
        same = c("rule0") == c(f"rule{level}")
        for k in by:
            same = same & c(f"{k}_0").eqNullSafe(c(f"{k}_{level}"))
        out = out.join(q, same)
    use = c("at2")
    for _, level in levels[-2::-1]:
        use = F.when(c(f"rows{level}") >= LEAST_ROWS, c(f"at{level}")).otherwise(use)
    out = out.withColumn("q", use)
    limits = []
    for name, rule in RULES.items():
        reach = F.greatest(rule["spreads"] * (c("q.q3") - c("q.q1")), F.lit(rule["least"]))
        of = c("rule0") == name
        limits.append(F.max(F.when(of, c("q.q2") + reach)).alias(f"{name}_high"))
        if rule["low"]:
            limits.append(F.max(F.when(of, c("q.q2") - reach)).alias(f"{name}_low"))
    return out.groupBy(*[c(f"{k}_0").alias(k) for k in keys]).agg(*limits)


def judge(measured: DataFrame, limits: DataFrame, groups: Sequence[str] = ("lang", "source")) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to measured texts; columns of these names are replaced.

    A text is kept when the base rules pass and every value lies within its group's limits.
    A group without limits has no text that passes the base rules.
    """
    names = [n for n in measured.columns if n.lower() not in ("base_failed", "kept")]
    m, ok = c("measures"), F.lit(True)
    slack = {name: r["short"] / F.sqrt(F.greatest(m["n_words"], F.lit(1))) for name, r in RULES.items()}
    for name, value in _thousandths(m).items():
        ok = ok & (value <= c(f"_l.{name}_high") + slack[name])
        if RULES[name]["low"]:
            ok = ok & (value >= c(f"_l.{name}_low") - slack[name])
    same = F.lit(True)
    own = limits.select(*[c(f"_g{i}").alias(f"_k{i}") for i in range(len(groups))],
                        F.struct(*[n for n in limits.columns if not n.startswith("_g")]).alias("_l"))
    for i, g in enumerate(groups):
        same = same & c(f"`{g}`").cast("string").eqNullSafe(c(f"_k{i}"))
    return measured.select(*[c(f"`{n}`") for n in names]).join(own, same, "left").select(
        *[c(f"`{n}`") for n in names], base_failed(m).alias("base_failed"),
        (~base_failed(m) & F.coalesce(ok, F.lit(False))).alias("kept"),
    )


MOST_GROUPS = 200_000
"""Groups whose limits are sent to every task; with more, the measured rows are exchanged."""


def quality_rules(
    records: DataFrame, *, text: str = "text", groups: Sequence[str] = ("lang", "source")
) -> DataFrame:
    """All columns of ``records`` with ``measures``, ``base_failed`` and ``kept``.

    Works on saved mix files with their session's language and origin, or on any table with a
    text and two columns to group by. Texts are measured twice, for the limits and for the
    verdict, which costs less than to write or to exchange them: the measures without texts are
    stored, the limits of the counted groups are broadcast, and no text moves. Nulls in a
    group column are a group; an empty table gives no rows.
    """
    narrow = measure_texts(records.select(*[c(f"`{n}`") for n in dict.fromkeys([text, *groups])]), text=text)
    measured = stored(narrow.select(*[c(f"`{g}`").cast("string").alias(f"g{i}") for i, g in enumerate(groups)], "measures"))
    own = [f"g{i}" for i in range(len(groups))]
    limits = stored(adaptive_limits(quantile_sketches(measured, own), len(groups)))
    if limits.count() <= MOST_GROUPS:
        limits = F.broadcast(limits)
    # The row number keeps Spark from measuring a text again for every use of its measures.
    whole = measure_texts(records, text=text).withColumn("_once", F.monotonically_increasing_id())
    judged = judge(whole, limits, groups)
    return judged.withColumn("kept", c("kept") & (c("_once") >= 0)).drop("_once")
