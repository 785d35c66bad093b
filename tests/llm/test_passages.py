import random

import public_tokenizers
import pyarrow as pa

from tests.llm import brute
from tests.llm.samples import mixes, none, odd_texts, words
from timelane.llm import repeated_passages
from timelane.llm.contamination import benchmark_windows, word_counts
from timelane.llm.repeated_passages import remove_repeated, repeated_spans
from timelane.llm.tokens import encoder


def _shared(seed):
    """Texts with passages of 20 to 90 words in common, whole copies and edited ones."""
    rng = random.Random(seed)
    passages = [words(rng, n, 10_000) for n in (20, 49, 50, 51, 90)]
    texts = [*odd_texts(), odd_texts()[9]]
    for _ in range(40):
        w = words(rng, rng.randint(0, 80), 10_000)
        for p in rng.sample(passages, rng.randint(0, 3)):
            w += [*p, *words(rng, rng.randint(0, 5), 10_000)]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    texts += texts[20:24]
    for t in texts[25:30]:
        w = t.split()
        if w:
            w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    return texts


def test_removed_words(spark):
    texts = _shared(1)
    want = brute.left_words(dict(enumerate(texts)))
    changed = 0
    for r in remove_repeated(mixes(spark, texts)).collect():
        i, total = r["mix"], len(brute.spaced(texts[r["mix"]]))
        assert brute.spaced(r["text"]) == want[i]
        assert (r["n_words"], r["n_removed"]) == (total, total - len(want[i]))
        if not r["n_removed"]:
            assert r["text"] == texts[i]
        changed += r["n_removed"] > 0
        assert r["words"] == "x"
    assert changed > 15


def test_one_window_in_all_texts(spark):
    common = " ".join(f"c{i}" for i in range(50))
    texts = [f"a{i} {common} z{i}" for i in range(300)]
    left = remove_repeated(mixes(spark, texts)).select("mix", "text").collect()
    assert all(t == (texts[i] if i == 0 else f"a{i} z{i}") for i, t in left)


def test_odd_tables_of_passages(spark):
    assert repeated_spans(none(spark)).count() == 0 and remove_repeated(none(spark)).count() == 0
    t = " ".join(f"c{i}" for i in range(60))
    rows = [(None, t), (None, t), (4, t), (4, t), (7, None)]
    df = spark.createDataFrame(rows, "mix bigint, text string")
    out = remove_repeated(df).collect()
    assert sorted((str(r["mix"]), r["n_removed"]) for r in out) == [("4", 0), ("4", 0), ("7", 0), ("None", 0), ("None", 0)]


def test_benchmark_windows(spark):
    rng = random.Random(4)
    items = [(f"i{k}", " ".join(words(rng, n, 300))) for k, n in enumerate((1, 3, 4, 5, 12, 13, 14, 40, 0, 13))]
    items += [("copy", items[6][1]), ("case", items[5][1].upper()), ("null", None), ("stop", "...")]
    texts = odd_texts()
    for _ in range(60):
        w = words(rng, rng.randint(0, 60), 300)
        if rng.random() < 0.7:
            part = rng.choice([x for _, x in items[:10] if x]).split()
            at = rng.randint(0, len(w))
            w[at:at] = [x.capitalize() + rng.choice(["", ",", "!"]) for x in part]
        texts.append(" ".join(w))
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = mixes(spark, texts)
    found = {}
    for r in benchmark_windows(df, bench).collect():
        hit, names = found.setdefault(r["mix"], (set(), set()))
        hit.update(range(r["first"], r["first"] + r["size"]))
        names.add(r["item"])
    want = brute.hits(dict(enumerate(texts)), items)
    counts = {r["mix"]: r["n_words"] for r in word_counts(df).collect()}
    for i, (n, hit, names) in want.items():
        got = found.get(i, (set(), set()))
        assert (counts[i], len(got[0]), got[1]) == (n, hit, names), texts[i]
    assert sum(len(h) for h, _ in found.values()) > 200


def test_odd_tables_of_items(spark):
    items = spark.createDataFrame([], "item_id string, text string")
    assert benchmark_windows(mixes(spark, ["a b"]), items).count() == 0
    some = spark.createDataFrame([("i", "a b"), (None, "a b"), ("i", "a b")], "item_id string, text string")
    assert benchmark_windows(none(spark), some).count() == 0
    rows = benchmark_windows(spark.createDataFrame([(1, "x a b"), (1, "x a b"), (None, "a b")], "mix bigint, text string"), some)
    assert {(r["mix"], r["item"], r["first"]) for r in rows.collect()} == {
        (1, None, 1), (1, "i", 1), (None, None, 0), (None, "i", 0)}
    assert rows.count() == 4


def test_passes_on_words_give_back_what_tokenizers_remember(monkeypatch):
    class Given:
        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(repeated_passages, "_texts", lambda *a: Given())
    encoder(public_tokenizers.path("byte_bpe_50k.json")).encode("some text")
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c"])], names=["k", "t"])
    assert encoder.cache_info().currsize and list(repeated_passages.window_runs(None)([batch])) == []
    assert not encoder.cache_info().currsize
