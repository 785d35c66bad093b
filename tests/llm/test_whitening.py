"""Whitened windows against numpy over the whole table, and the solver against hard matrices."""

from __future__ import annotations

import numpy as np
import pytest

from timelane.llm import whitening
from timelane.llm.bidiagonal import dqds, singular_directions
from timelane.llm.whitening import whiten_windows


def plain(vectors):
    """Everything the operator gives, from a covariance matrix and numpy's own solver."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    deviation = [sum((int(v) * n - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return x - sums / n, n, deviation, values[order], basis[:, order]


def compare(rows, vectors, names, most=16, tolerance=1e-9):
    centred, n, deviation, values, basis = plain(vectors)
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(rows) == k * len(vectors)
    at = {name: i for i, name in enumerate(names)}
    got = np.zeros((len(vectors), k))
    for r in rows:
        i = at[(r["mix"], r["track"], r["start"])]
        got[i, r["component"] - 1] = r["whitened"]
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
    want = centred @ basis[:, :k] / np.sqrt(values[:k])
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < tolerance * np.abs(want).max()


def blocks(spark, vectors, extra=()):
    names = [(i % 3, i // 3, 16 * i) for i in range(len(vectors))]
    rows = [(*k, [float(v) for v in x], "x", i) for i, (k, x) in enumerate(zip(names, vectors))]
    schema = "mix int, track int, start bigint, values array<double>, n string, component int"
    return names, spark.createDataFrame([*rows, *extra], schema)


def test_equals_numpy_with_copies_and_unfit_rows(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((700, 12)) * np.linspace(3, 0.3, 12)
    vectors[300:] = np.where(rng.random((400, 1)) < 0.8, vectors[7], vectors[300:])
    bad = [None, [], [1.0] * 5, [1.0] * 11 + [None], [1.0] * 11 + [float("nan")], [float("inf")] + [1.0] * 11, [1e300] + [1.0] * 11]
    names, rows = blocks(spark, vectors, [(9, 9, 9, v, "x", 0) for v in bad])
    compare(whiten_windows(rows.repartition(40)).collect(), vectors, names)


def test_fewer_directions_than_entries(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.integers(-9, 9, (200, 3)) @ rng.integers(-4, 5, (3, 20))).astype(float)
    names, rows = blocks(spark, vectors)
    compare(whiten_windows(rows).collect(), vectors, names)


def test_tables_without_differences(spark):
    names, rows = blocks(spark, np.ones((5, 4)))
    assert whiten_windows(rows).collect() == []
    assert whiten_windows(rows.limit(0)).collect() == []
    assert whiten_windows(rows.selectExpr("mix", "track", "start", "cast(null as array<double>) as values")).collect() == []
    with pytest.raises(ValueError):
        whiten_windows(rows, keys="component")
    null_key = rows.selectExpr("cast(null as int) as mix", "track", "start", "transform(values, v -> v * track) as values")
    assert {r["mix"] for r in whiten_windows(null_key).collect()} == {None}


def test_deviation_past_a_long_is_null():
    w = whitening.Whitener(1 << 30, [0, 0], np.ones(1), 1.0, np.ones((2, 1)))
    x = np.array([[1 << 39, 1], [3, 4]], np.int64)
    assert w.deviations(x) == [None, 25 * (1 << 60) if 25 * (1 << 60) < 1 << 63 else None]
    assert w.deviations(x[1:] // 2) == [(1 + 4) << 60]


@pytest.mark.parametrize("name", ["plain", "graded", "equal", "near", "identity", "low rank", "wilkinson", "zero"])
def test_solver(name):
    rng = np.random.default_rng(1)
    turn = lambda m, n: np.linalg.qr(rng.standard_normal((m, n)))[0]
    a = {
        "plain": lambda: rng.standard_normal((90, 40)),
        "graded": lambda: rng.standard_normal((90, 40)) * np.logspace(0, -7, 40),
        "equal": lambda: turn(90, 40) @ np.diag([*[5.0] * 10, *np.linspace(4, 1, 30)]) @ turn(40, 40),
        "near": lambda: turn(90, 40) @ np.diag([*(5 + 1e-10 * np.arange(10)), *np.linspace(4, 1, 30)]) @ turn(40, 40),
        "identity": lambda: 3 * np.eye(20),
        "low rank": lambda: rng.standard_normal((90, 6)) @ rng.standard_normal((6, 40)),
        "wilkinson": lambda: np.linalg.cholesky(np.diag(np.abs(np.arange(-10.0, 11)) + 3) + np.eye(21, k=1) + np.eye(21, k=-1)).T,
        "zero": lambda: np.zeros((5, 5)),
    }[name]()
    squares, v = singular_directions(np.linalg.qr(a)[1])
    want = np.linalg.svd(a, compute_uv=False) ** 2
    top = max(want[0], 1e-300)
    assert np.abs(squares - want).max() <= 1e-13 * top
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-11
    assert np.abs(a.T @ (a @ v) - v * squares).max() <= 1e-13 * top


def test_small_values_keep_their_digits():
    """The bidiagonal with rows 1, 1e-8 ... has squares whose product is known exactly."""
    d = 10.0 ** -np.arange(0, 60, 4)
    squares = dqds(d, d[:-1] * 0.5)
    assert np.log10(squares).sum() == pytest.approx(2 * np.log10(d).sum(), abs=1e-12)
