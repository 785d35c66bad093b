"""Text quality by a regularised quadratic discriminant.

Each class has a Gaussian over transformed statistics of the text; its covariance is shrunk
towards the pooled one and its diagonal. Fitting needs only sums of products, which Spark adds
up over all labelled rows. The Cholesky factor of each class is worked out once and sent to the
tasks, which score by the difference of the log densities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelane.llm.words import SPACED_LOWER, mix, shingle_sums, window_starts, word_slices

c = F.col

STATISTICS = [
    "words", "word_length", "symbols", "pipes", "upper", "digits", "marks", "shouts", "lines",
    "beyond_ascii", "distinct_words", "distinct_pairs", "top_word", "long_words",
]
SHRINKAGE = 0.15
"""Share of the pooled covariance in a class covariance."""
RIDGE = 0.05
"""Share of the pooled variances put on the diagonal."""
TEMPER = 0.5
"""The log density ratio counts so much: statistics of one text lean on each other."""


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_CLASSES = {
    "symbols": _class("#*$%&<>"), "pipes": _class("|"),
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _class("0123456789"),
    "marks": _class(".,;:"), "shouts": _class("!?"), "lines": _class("\n"),
    "beyond_ascii": np.arange(256) >= 0xC0,
}


def _per_text(value: np.ndarray, bound: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(value, dtype=np.int64)])
    return run[bound[1:]] - run[bound[:-1]]


def _distinct(value: np.ndarray, text: np.ndarray, n: int):
    """Distinct values of each text, and how often the commonest occurs."""
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, text[at], np.diff(np.append(at, len(value))))
    return np.bincount(text[at], minlength=n), top


def _statistics(words, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for every text of a slice."""
    n = words.counts()
    h = words.hashes()
    least = np.maximum(n, 1)
    count = {k: _per_text(v[words.data], offsets) for k, v in _CLASSES.items()}
    length = words.end - words.start
    chars = _per_text(length, words.first)
    text = np.repeat(np.arange(len(n)), n)
    distinct, top = _distinct(h, text, len(n))
    start, of = window_starts(words, 2)
    pairs, _ = _distinct(mix(shingle_sums(h)(start, 2)), of, len(n))
    columns = {
        "words": np.log1p(n), "word_length": chars / least,
        "distinct_words": distinct / least * np.log1p(n) / 3, "distinct_pairs": pairs / np.maximum(n - 1, 1),
        "top_word": np.log1p(100 * top / least),
        "long_words": np.sqrt(_per_text(length > 14, words.first) / least),
    }
    for k, v in count.items():
        columns[k] = np.log1p(20 * v / least)
    return np.stack([columns[k] for k in STATISTICS], 1)


def text_statistics(records: DataFrame, *, key: str = "mix", text: str = "text") -> DataFrame:
    """The key and ``statistics`` (doubles, in the order of STATISTICS) of every row.

    Nothing but the text is read. A null or empty text has those of no words.
    """
    def measure(batches):
        for batch in batches:
            for at, to, words in word_slices(batch.column(1), SPACED_LOWER):
                values = _statistics(words, words.offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at),
                     pa.ListArray.from_arrays(
                         pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))],
                    names=[key, "statistics"],
                )

    return records.select(c(f"`{key}`").cast("bigint"), c(f"`{text}`").cast("string")).mapInArrow(
        measure, f"`{key}` bigint, statistics array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and constants of the two classes."""

    center: np.ndarray
    scale: np.ndarray
    mean: list[np.ndarray]
    factor: list[np.ndarray]
    constant: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, from 0 to 1."""
        if not self.mean:
            return np.full(len(x), 0.5)
        x = (x - self.center) / self.scale
        log = [
            k - 0.5 * (((x - m) @ f.T) ** 2).sum(1)
            for m, f, k in zip(self.mean, self.factor, self.constant)
        ]
        return 1 / (1 + np.exp(np.clip(TEMPER * (log[0] - log[1]), -50, 50)))


def fit_discriminant(labelled: DataFrame, *, label: str = "quality") -> Discriminant:
    """Fit on ``statistics`` and a label of 0 or 1; every row counts, other labels do not.

    Without rows of both classes the model scores 0.5 everywhere.
    """
    width = len(STATISTICS) + 1

    def sums(batches):
        total = np.zeros((2, width, width))
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        k, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k), pa.array(i), pa.array(j), pa.array(total[k, i, j])], names=["k", "i", "j", "v"])

    rows = labelled.select("statistics", c(label).cast("int").alias("y")).where("y in (0, 1)")
    total = np.zeros((2, width, width))
    for r in rows.mapInArrow(sums, "k bigint, i bigint, j bigint, v double").groupBy("k", "i", "j").agg(
            F.sum("v").alias("v")).collect():  # two matrices
        total[r["k"], r["i"], r["j"]] = r["v"]
    n = total[:, 0, 0]
    if n.min() < 1:
        return Discriminant(np.zeros(width - 1), np.ones(width - 1), [], [], [])
    both = total.sum(0)
    center = both[0, 1:] / n.sum()
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / n.sum() - center**2, 1e-9))
    mean = [(total[k, 0, 1:] / n[k] - center) / scale for k in (0, 1)]
    own = []
    for k in (0, 1):
        raw = total[k, 1:, 1:] / n[k] - np.outer(total[k, 0, 1:], total[k, 0, 1:]) / n[k] ** 2
        own.append(raw / np.outer(scale, scale))
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factor, constant = [], []
    for k in (0, 1):
        cov = (1 - SHRINKAGE) * own[k] + SHRINKAGE * pooled
        cov = (1 - RIDGE) * cov + RIDGE * np.diag(np.maximum(np.diag(pooled), 1e-3))
        lower = np.linalg.cholesky(cov)
        factor.append(np.linalg.inv(lower))
        constant.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum()))
    return Discriminant(center, scale, mean, factor, constant)


def score_quality(statistics: DataFrame, model: Discriminant, *, key: str = "mix") -> DataFrame:
    """The key and ``score`` of every row of ``text_statistics``."""
    held = statistics.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held.value.score(_matrix(batch.column(1))))], names=[key, "score"])

    return statistics.select(key, "statistics").mapInArrow(score, f"`{key}` bigint, score double")
