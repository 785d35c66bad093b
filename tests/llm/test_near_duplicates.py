import importlib
import random

import pytest

from tests.llm import brute
from tests.llm.samples import mixes, near_copies, none, odd_texts
from timelane.llm import near_duplicates
from timelane.llm.components import components
from timelane.llm.near_duplicates import near_duplicate_sets, trees_for


@pytest.mark.parametrize("shingle", [2, 5])
def test_components_of_mix_files(spark, shingle):
    texts = [*odd_texts(), *near_copies(), "one", "a B", *odd_texts()[8:10]]
    want = brute.components(dict(enumerate(texts)), shingle)
    rows = near_duplicate_sets(mixes(spark, texts), shingle=shingle).collect()
    assert {r["mix"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["mix"] == r["component_id"]) for r in rows)
    assert len({v[1] for v in want.values()}) < len(texts) - 20


def test_large_group_at_the_limit(spark):
    """Copies around the wanted similarity: a node of many texts with many components."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for at in rng.sample(range(120), rng.randint(3, 9)):
            w[at] = f"n{rng.randint(1, 10**6)}"
        texts.append(" ".join(w))
    want = brute.components(dict(enumerate(texts)), 2)
    rows = near_duplicate_sets(mixes(spark, texts), shingle=2).collect()
    assert {r["mix"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert 2 < len({v[1] for v in want.values()}) < 150


def test_nodes_that_branch_are_searched_again(spark, monkeypatch):
    """Pairs just above the limit in one large node; the first search is made to find none."""
    monkeypatch.setattr(near_duplicates, "SMALL", 16)
    monkeypatch.setattr(near_duplicates, "DEEPEST", 4)
    confirm, new_signs, again = near_duplicates._confirm, near_duplicates._new_signs, []
    monkeypatch.setattr(near_duplicates, "_confirm", lambda pairs, *a: confirm(pairs if again else pairs.limit(0), *a))
    monkeypatch.setattr(near_duplicates, "_compared_nodes", lambda rows, *a: rows.selectExpr("node as a", "node as b").limit(0))
    monkeypatch.setattr(near_duplicates, "_new_signs", lambda *a: again.append(a[2]) or new_signs(*a))
    texts = []
    for i in range(40):
        both = [f"core{k}" for k in range(75)] + [f"p{i}x{k}" for k in range(14)]
        texts += [" ".join(both + [f"o{i}{side}{k}" for k in range(11)]) for side in "ab"]
    rows = near_duplicate_sets(mixes(spark, texts), shingle=1).collect()
    linked = sum(r["component_id"] == r["mix"] // 2 * 2 for r in rows)
    assert again == [1] and linked >= 72


def test_nodes_with_the_same_texts_branch_each(spark):
    rows = [(node, text, 9) for node, n in ((1, 600), (2, 600), (3, 20), (4, 20)) for text in range(n)]
    df = spark.createDataFrame(rows, "node bigint, text bigint, shingles bigint")
    for deepest, want in ((False, 3), (True, 2)):
        assert near_duplicates._open_nodes(df, None, deepest).select("node").distinct().count() == want


def test_leaders_of_the_own_component_give_no_pairs(spark):
    rows = [(node, text, 9) for node in (1, 2, 3) for text in range(40)]
    found = spark.createDataFrame([(t, t // 30 * 30) for t in range(40)], "node bigint, component bigint")
    df = spark.createDataFrame(rows, "node bigint, text bigint, shingles bigint")
    pairs = near_duplicates._leader_pairs(near_duplicates._open_nodes(df, found, False)).collect()
    assert pairs and all((r["a"] < 30) != (r["b"] < 30) for r in pairs)


def test_searches_reach_the_recall():
    trees = near_duplicates.shared_trees_for(0.9999, 0.8)
    for depth in range(near_duplicates.FIRST_DEPTH, near_duplicates.DEEPEST + 1):
        n = near_duplicates.searches_for(0.9999, 0.8, trees, depth)
        assert near_duplicates.missed(0.8, trees, depth) ** n <= 1e-4 + 1e-9


def test_odd_tables(spark):
    assert near_duplicate_sets(none(spark)).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "A b C"), (9, None), (8, None)]
    out = near_duplicate_sets(spark.createDataFrame(rows, "mix bigint, text string"), shingle=2).collect()
    got = sorted(((r["mix"], r["component_id"], r["kept"]) for r in out), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (5, 3, False), (5, 3, False), (3, 3, True),
                          (9, 9, True), (8, 8, True)], key=str)


def test_trees_reach_the_recall():
    assert trees_for(0.9999, 0.8) == 11 and trees_for(0.9, 0.8) < 4


def test_components_of_links(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_by_joins_and_in_one_task(spark, monkeypatch):
    """Random links, chains and stars give the same components both ways."""
    module = importlib.import_module("timelane.llm.components")
    rng = random.Random(4)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(i + 1, i) for i in range(200, 230)]
    df = spark.createDataFrame([*links, *links[:9]], "a bigint, b bigint")
    one = sorted(components(df).collect())
    monkeypatch.setattr(module, "FEW", 0)
    assert one == sorted(components(df).collect()) and len(one) == len({x for a, b in links for x in (a, b) if a != b})


def test_few_links_meet_without_rounds(spark, monkeypatch):
    module = importlib.import_module("timelane.llm.components")
    monkeypatch.setattr(module, "_flat", lambda edges: pytest.fail("rounds of joins"))
    df = spark.createDataFrame([(i, i + 1) for i in range(50)], "a bigint, b bigint")
    assert {r["component"] for r in components(df).collect()} == {0}


def test_nodes_above_small_are_compared_before_they_branch(spark, monkeypatch):
    """Texts with a common passage, none alike but one pair: no node branches, nothing is searched again."""
    monkeypatch.setattr(near_duplicates, "SMALL", 128)
    monkeypatch.setattr(near_duplicates, "_new_signs", lambda *a: pytest.fail("searched again"))
    texts = [" ".join([f"c{k}" for k in range(129)] + [f"o{i}x{k}" for k in range(21)]) for i in range(240)]
    texts.append(texts[7].replace("o7x3 ", "other "))
    rows = near_duplicate_sets(mixes(spark, texts), shingle=1).collect()
    assert {r["mix"]: r["component_id"] for r in rows} == {i: i for i in range(240)} | {240: 7}
