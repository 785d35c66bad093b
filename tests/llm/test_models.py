import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.samples import mixes, none, odd_texts, words
from timelane.llm import cross_entropy
from timelane.llm import main_text as M
from timelane.llm.cross_entropy import DISCOUNT, LENGTHS, cross_entropy_difference, shared_vocabulary
from timelane.llm.dom import Page
from timelane.llm.labelled_pages import COPIES, LAYOUTS, MARK, labelled_pages
from timelane.llm.quality_model import STATISTICS, fit_discriminant, score_quality, text_statistics
from timelane.llm.words import SPACED_LOWER, find_words


def test_discriminant_tells_classes_apart(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        w = words(rng, rng.randint(15, 120), 3000)
        if i % 4 == 0:
            w = [x + rng.choice(["###", "$$", "!!"]) for x in w]
        rows.append((i, " ".join(w), int(i % 4 != 0)))
    df = spark.createDataFrame(rows, "mix bigint, text string, quality int")
    st = text_statistics(df).join(df.select("mix", "quality"), "mix")
    model = fit_discriminant(st.where("mix < 300"))
    got = {r["mix"]: r["score"] for r in score_quality(st, model).collect()}
    right = [(got[i] >= 0.5) == bool(q) for i, _, q in rows if i >= 300]
    assert sum(right) / len(right) > 0.97
    # The score is the density ratio of the fitted Gaussians.
    x = np.array([r["statistics"] for r in st.where("mix >= 300").limit(5).collect()])
    z = (x - model.center) / model.scale
    log = [k - 0.5 * np.einsum("ij,jk,ik->i", z - m, f.T @ f, z - m) for m, f, k in zip(model.mean, model.factor, model.constant)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(0.5 * (log[0] - log[1]))))


def test_statistics_of_odd_texts(spark):
    texts = odd_texts()
    rows = {r["mix"]: r["statistics"] for r in text_statistics(mixes(spark, texts)).collect()}
    assert len(rows) == len(texts) and all(np.isfinite(v).all() and len(v) == len(STATISTICS) for v in rows.values())
    for i, t in enumerate(texts):
        w = brute.spaced(t, True)
        assert math.isclose(rows[i][0], math.log1p(len(w)))
        assert math.isclose(rows[i][STATISTICS.index("word_length")], sum(map(len, w)) / max(len(w), 1))
        pairs = len(set(zip(w, w[1:]))) / max(len(w) - 1, 1)
        assert math.isclose(rows[i][STATISTICS.index("distinct_pairs")], pairs)
    assert text_statistics(none(spark)).count() == 0


def test_discriminant_without_labels(spark):
    st = text_statistics(mixes(spark, ["a b", None]))
    model = fit_discriminant(st.withColumn("quality", st["mix"] * 0 + 1))
    assert [r["score"] for r in score_quality(st, model).collect()] == [0.5, 0.5]


def test_cross_entropy_against_counts(spark):
    rng = random.Random(3)
    texts = [*odd_texts(), *[" ".join(words(rng, rng.randint(1, 40), 30)) for _ in range(80)]]
    targets = [i for i in range(len(texts)) if i % 3 == 0]
    df = mixes(spark, texts)
    keys = spark.createDataFrame([(i,) for i in [*targets, targets[1], 999]] + [(None,)], "mix bigint")
    count = Counter(w for t in texts for w in brute.spaced(t, True))
    order = sorted(count.values(), reverse=True)
    size = max(k for k in range(1, 30) if order[k - 1] > order[k])  # no tie at the edge
    known = {w for w, n in count.items() if n >= order[size - 1]}
    got = {r["mix"]: r for r in cross_entropy_difference(df, keys, size=size).collect()}
    assert len(shared_vocabulary(df, size=size)) == size

    def symbols(t):
        return [w if w in known else min(len(w), LENGTHS) for w in brute.spaced(t, True)]

    def model(which):
        pair, single = Counter(), Counter()
        for i in which:
            s = symbols(texts[i])
            for a, b in zip(["start", *s], s):
                pair[a, b] += 1
                single[b] += 1
        width, n = size + LENGTHS + 1, sum(single.values())
        of, kinds = Counter(), Counter()
        for (a, _), k in pair.items():
            of[a] += k
            kinds[a] += 1

        def loss(a, b):
            p = (single[b] + 1) / (n + width)
            if of[a]:
                p = (max(pair[a, b] - DISCOUNT, 0) + DISCOUNT * kinds[a] * p) / of[a]
            return -math.log(p)

        return loss

    both = model(targets), model(range(len(texts)))
    for i, t in enumerate(texts):
        s = symbols(t)
        mean = [sum(m(a, b) for a, b in zip(["start", *s], s)) / max(len(s), 1) for m in both]
        r = got[i]
        assert r["n_words"] == len(s)
        assert r["target_loss"] == pytest.approx(mean[0], abs=1e-5)
        assert r["background_loss"] == pytest.approx(mean[1], abs=1e-5)
        assert r["difference"] == pytest.approx(mean[0] - mean[1], abs=2e-5)


def test_cross_entropy_of_odd_tables(spark):
    keys = spark.createDataFrame([(1,)], "mix bigint")
    assert cross_entropy_difference(none(spark), keys).count() == 0
    rows = cross_entropy_difference(mixes(spark, [None, "", "a b", "a b"]), keys).collect()
    assert len(rows) == 4 and all(np.isfinite(r["difference"]) for r in rows)


def test_cross_entropy_knows_words_beyond_the_commonest(spark):
    """Two texts that differ in rare words of equal length, behind 2,000 commoner ones."""
    common = [f"common{i}" for i in range(2000)]
    texts = [" ".join(common)] * 9 + ["alpha"] * 6 + ["gamma"] * 6
    keys = spark.createDataFrame([(i,) for i in range(9, 12)], "mix bigint")
    got = {r["mix"]: r["difference"] for r in cross_entropy_difference(mixes(spark, texts), keys).collect()}
    assert got[14] < got[20]
    assert got[9] == got[14]


def test_cross_entropy_is_the_same_in_many_small_buckets(spark, monkeypatch):
    """With hashed words, contexts cut over buckets, and fields for words and targets."""
    rng = random.Random(5)
    texts = [*odd_texts(), *[" ".join(words(rng, rng.randint(1, 60), 80)) for _ in range(90)], "a a a a a a b"]
    rows = [(i if i % 10 else None, t) for i, t in enumerate(texts)] + [(3, "a b c"), (3, "a b c")]
    df = spark.createDataFrame(rows, "mix bigint, text string").repartition(6).localCheckpoint()
    keys = spark.createDataFrame([(i,) for i in [*range(0, 90, 2), 4, 999]] + [(None,)], "mix bigint")

    def run():
        got = cross_entropy_difference(df, keys).withColumn("mix", F.coalesce("mix", F.lit(-1)))
        return sorted(tuple(r) for r in got.collect())

    whole = run()
    for name, value in (("NUMBERED", 6), ("BUCKET_WORDS", 16), ("LISTED", 3)):
        monkeypatch.setattr(cross_entropy, name, value, raising=False)
    cut = run()
    assert len(whole) == len(rows) and [r[:2] for r in cut] == [r[:2] for r in whole]
    assert np.allclose([r[2:] for r in cut], [r[2:] for r in whole], rtol=0, atol=1e-9)


def test_cross_entropy_keeps_no_row_per_pair(spark, monkeypatch):
    """Pairs move and lie as packed numbers, in less room than their texts."""
    rows, room = [], []
    keep = cross_entropy.stored

    def noted(df):
        table = keep(df)
        rows.append(table.count())
        if "body" in table.columns:
            room.append(table.agg(F.sum(F.length("body"))).first()[0])
        return table

    monkeypatch.setattr(cross_entropy, "stored", noted)
    rng = random.Random(6)
    texts = [" ".join(f"word{rng.randrange(3000)}" for _ in range(300)) for _ in range(300)]
    pairs = {(a, b) for t in texts for a, b in itertools.pairwise(t.split())}
    df = mixes(spark, texts).coalesce(1)
    got = cross_entropy_difference(df, spark.createDataFrame([(1,)], "mix bigint"))
    assert got.count() == 300
    assert max(rows) < len(pairs) / 4
    assert room and max(room) < sum(map(len, texts))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_vocabulary_is_the_words_of_the_least_count(spark, monkeypatch):
    monkeypatch.setattr(cross_entropy, "LISTED", 10)  # so that bit fields are used
    texts = [" ".join(f"w{i}" for i in range(3000) if i % 7 >= k) for k in range(7)]
    known = cross_entropy._known(mixes(spark, texts), "mix", "text", None)
    h = find_words(*_bytes([f"w{i}" for i in range(3000)]), SPACED_LOWER).hashes().view(np.int64)
    assert known(h).tolist() == [i % 7 + 1 >= cross_entropy.LEAST_COUNT for i in range(3000)]


def _bytes(texts):
    joined = np.frombuffer("".join(texts).encode(), np.uint8)
    return joined, np.cumsum([0, *[len(t) for t in texts]])


def test_head_without_its_end_tag():
    body = "<article><p>Some words, here.</p></article>"
    for html in (f"<html><head><title>x</title><body>{body}", f"<head><meta charset=utf-8><style>p {{}}</style>{body}",
                 f"<head><title>x</title></head><body>{body}", f"<head><title>x</title><a href=y></a>{body}"):
        assert [text for _, text in Page(html).blocks] == ["Some words, here."]
    assert [text for _, text in Page("<head><title>x</title>Bare <b>text</b>").blocks] == ["Bare text"]
    assert Page("<head><noscript><img src=y></noscript><title>x</title> </head>").blocks == []


@pytest.fixture(scope="module")
def model(spark):
    return M.default_model(spark)


def test_marginals_equal_enumeration(model):
    html = "<body><nav><p>a b c</p></nav><article><h1>x</h1><div>some words here, and more.</div></article></body>"
    page = Page(html)
    nodes, features = page.nodes, M._features(Page(html))
    page = Page(html)
    weight = [0.0] * len(nodes)
    whole = 0.0
    for states in itertools.product(M.STATES, repeat=len(nodes)):
        value = model.root[states[0]]
        for i, s in enumerate(states):
            value += M.WEIGHT * sum(model.features[f][s] for f in features[i] if f in model.features)
            if i:
                value += model.edges.get(nodes[i].tag, model.any_edge)[states[nodes[i].parent]][s]
        p = math.exp(value)
        whole += p
        for i, s in enumerate(states):
            weight[i] += p * (s == M.CONTENT)
    assert model.marginals(page) == pytest.approx([w / whole for w in weight])


def test_layouts_left_out_of_training(spark):
    """Every layout is read by a model trained on the others."""
    pages = labelled_pages()
    right = total = 0
    for k in range(len(LAYOUTS)):
        own = pages[k * COPIES : (k + 1) * COPIES]
        others = [p for p in pages if p not in own]
        model = M.train_tree_model(spark.createDataFrame([(p,) for p in others], "html string"))
        for html in own:
            labelled, content = Page(html, MARK), model.marginals(Page(html.replace(MARK, "")))
            for i, text in labelled.blocks:
                right += len(text) * ((content[i] >= 0.5) == bool(labelled.nodes[i].marked))
                total += len(text)
    assert right / total > 0.75


def test_text_of_pages(spark, model):
    article = "<article><h1>Head &amp; shoulders</h1><p>One  two\n<b>three</b>, and some more words here.<p>Caf&eacute; &copy now<br>or later.</article>"
    pages = [
        None, "", "plain text only, and quite a lot of it. " * 5,
        f"<html><body><nav><ul><li><a href=x>Menu</a></li></ul></nav>{article}<footer>&copy; me</footer></body>",
        f"<head><title>T</title><script>if (a<b) '</p>'</script></head><div class=ad>Buy now</div>{article}<![if x]>",
        "<p>unclosed <div", "<div>" * 3000 + "deep" + "</div>" * 10,
    ]
    df = spark.createDataFrame([(i, h, "t") for i, h in enumerate(pages)] + [(3, pages[3], "t")], "page bigint, html string, text string")
    rows = M.extract_main_text(df, model).collect()
    assert len(rows) == len(pages) + 1 and rows[0].asDict().keys() == {"page", "text"}
    text = {r["page"]: r["text"] for r in rows}
    main = "Head & shoulders\nOne two three, and some more words here.\nCafé © now or later."
    assert text[0] == text[1] == "" and text[3] == main and text[4] == main
    assert M.extract_main_text(df.limit(0), model).count() == 0
    empty = M.train_tree_model(spark.createDataFrame([(None,)], "html string"))
    assert all(0 <= x <= 1 for x in empty.marginals(Page(pages[3])))
