"""Saved mix files with texts of every kind."""

import random


def words(rng, n, pool=400):
    return [f"w{rng.randint(1, pool)}" for _ in range(n)]


def odd_texts():
    """Texts that break careless code: nothing, blanks, one word, odd bytes, one very long."""
    return [
        None, "", " \n\t ", "one", "One ONE one", "a b", "é ü ÄÖ ß x", "x\x1cy z", "a" * 3000,
        " ".join(f"long{i % 977}" for i in range(30_000)), "tab\tand\x0bmore\x0cspace\r\nend", "<|endoftext|> a",
    ]


def near_copies(seed=3, groups=6, size=8):
    """Groups of texts that differ in some words, exact copies among them."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = words(rng, 40 + 20 * g, 5000)
        for k in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"new{rng.randint(1, 9999)}"
            out.append(" ".join(w))
    return out


def mixes(spark, texts, **more):
    """A table of mix files; an extra column whose name operators use themselves."""
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "mix bigint, text string, words string")


def none(spark):
    return spark.createDataFrame([], "mix bigint, text string, words string")
