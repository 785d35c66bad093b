import random

from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.samples import mixes, odd_texts, words
from timelane.llm.quality_rules import measure_texts, quality_rules, quantile_sketches


def test_measures(spark):
    rng = random.Random(5)
    texts = [*odd_texts(), "a b c d e a b c d e f", "x x x x x x", "l 1\nl 1\n\n \nl 2", "#a *$ |", "a\nb\na\nb"]
    texts += [" ".join(words(rng, rng.randint(0, 60), 4)) for _ in range(60)]
    for r in measure_texts(mixes(spark, texts)).select("mix", "measures.*").collect():
        assert {k: v for k, v in r.asDict().items() if k != "mix"} == brute.measures(texts[r["mix"]]), texts[r["mix"]][:80]


def _table(spark, rows):
    return spark.createDataFrame(rows, "mix bigint, text string, lang string, source string, kept string, _g0 int")


def test_limits_follow_the_group(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1200):
        loud = i % 3 == 0  # every word of this source ends in a symbol, and that is usual there
        w = words(rng, 60, 10_000)
        if loud or i % 100 == 1:
            w = [x + "$" for x in w]
        rows.append((i, " ".join(w), None if loud else "en", "loud" if loud else "calm", "x", 1))
    rows += [(5000 + i, t, "xx", None, None, None) for i, t in enumerate(odd_texts())]
    rows += [rows[1], rows[2]]
    out = quality_rules(_table(spark, rows)).collect()
    assert len(out) == len(rows)
    kept = {r["mix"]: r["kept"] for r in out}
    for i in range(1200):
        assert kept[i] == (i % 3 == 0 or i % 100 != 1), i
    assert not kept[5000] and not kept[5003]
    assert {"_g0", "lang", "source"} <= set(out[0].asDict())


def test_sketches_merge_and_empty(spark):
    rows = [(i, " ".join(f"w{i}{k}" for k in range(20)), "en", "s", "", 0) for i in range(40)]
    a, b = (measure_texts(_table(spark, rows[k::2])) for k in (0, 1))
    both = quantile_sketches(a).unionByName(quantile_sketches(b)).groupBy("_g0", "_g1", "rule", "bin").agg(F.sum("n").alias("n"))
    whole = quantile_sketches(measure_texts(_table(spark, rows)))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect()))
    assert quality_rules(_table(spark, [])).count() == 0
