"""Aligned tokens against plain loops over whole texts, with ranges of a few bytes too."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import islice, takewhile

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from timelane.llm.alignment import align_tokens, byte_ranges, compose, fragment, pair_of

LEFT, RIGHT = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
TEXTS = [
    None, "", " ", "\n", "a", "plain words, and more of them", "a<|endoftext|>b </s> <s>", "sp▁ace", "x  y\n\n z ",
    "größe straße été 中文字 and 😀 done", "tab\tand\r\nlines", "same words same words same words " * 9,
    "word" * 40, "ab " * 60 + "▁", "é" * 50 + " " + "0123456789" * 5,
]


def plain(texts):
    """What the contract says, with sets and loops."""
    left, right = Tokenizer.from_file(LEFT), SentencePieceProcessor(model_file=RIGHT)
    left.encode_special_tokens = True
    names = {i: s for s, i in left.get_vocab().items()}
    shown = {ch: b for b, ch in enumerate(__import__("timelane.llm.tokens", fromlist=["_SHOWN"])._SHOWN)}

    def right_bytes(i):
        s = right.id_to_piece(i)
        return bytes([int(s[3:5], 16)]) if right.is_byte(i) else s.replace("▁", " ").encode()

    docs = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = [(i, bytes(shown[ch] for ch in names[i])) for i in left.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, right_bytes(i)) for i in right.encode(text)] if text else []
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, near = [], 0
        for x, f, t in spans[0]:
            while near < len(spans[1]) and spans[1][near][2] <= f:
                near += 1
            links += [(x, y) for y, g, u in takewhile(lambda s: s[1] < t, islice(spans[1], near, None))]
        common = sorted({t for _, _, t in spans[0]} & {t for _, _, t in spans[1]})
        groups, parts = [], [iter(side) for side in spans]
        for high in common:
            sides = []
            for part in parts:
                ids = []
                for i, _, t in part:
                    ids.append(str(i))
                    if t == high:
                        break
                sides.append(",".join(ids))
            groups.append("|".join(sides))
        docs.append((len(a), len(b), links, groups))
    counts = Counter(pair for d in docs for pair in d[2])
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
         sum(counts[p] for p in links), ";".join(groups))
        for n_a, n_b, links, groups in docs
    ]


@pytest.mark.parametrize("size", [1 << 16, 64, 7])
def test_equals_plain_loops_for_any_size_of_range(spark, size):
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "mix long, text string, groups long")
    got = {r["mix"]: tuple(r[x] for x in RESULTS) for r in align_tokens(rows, LEFT, RIGHT, size=size).collect()}
    assert [got[i] for i in range(len(TEXTS))] == plain(TEXTS)


def test_odd_tables(spark):
    rows = spark.createDataFrame([(None, "one two"), (None, "one two"), (1, "three"), (1, "four " * 30)], "mix long, text string")
    got = align_tokens(rows, LEFT, RIGHT, size=32).collect()
    want = plain([r["text"] for r in rows.collect()])
    assert sorted(tuple(r[x] for x in RESULTS) for r in got) == sorted(want)
    assert sorted(str(r["mix"]) for r in got) == ["1", "1", "None", "None"]
    assert align_tokens(rows.limit(0), LEFT, RIGHT).collect() == []
    with pytest.raises(ValueError):
        align_tokens(rows.withColumnRenamed("mix", "n_a"), LEFT, RIGHT, key="n_a")


def test_fragments_compose_in_any_order():
    """((x y) z) = (x (y z)), and a text cut anywhere gives the groups of the whole."""
    pair, rnd = pair_of(LEFT, RIGHT), random.Random(5)
    text = " " + "".join(rnd.choice(["über ", "words, ", "中文", "x1y2 ", "longerword", "\n", "  "]) for _ in range(300))
    parts = [fragment(pair, low, high, begin, piece, n) for n, (low, high, begin, piece) in enumerate(byte_ranges(text, 40))]
    assert sum(p["first"] is None for p in parts[1:-1]) >= 0 and len(parts) > 20

    def closed(parts):
        return {(p["first"], p["a"], p["b"]) for p in parts if p["a"]}

    def fold(parts):
        groups, whole = [], parts[0]
        for p in parts[1:]:
            whole, group = compose(whole, p)
            groups += [(group["first"], group["pre_a"], group["pre_b"])] if group else []
        return whole, groups

    def tree(parts):
        if len(parts) == 1:
            return parts[0], []
        half = rnd.randint(1, len(parts) - 1)
        (x, gx), (y, gy) = tree(parts[:half]), tree(parts[half:])
        whole, group = compose(x, y)
        return whole, gx + gy + ([(group["first"], group["pre_a"], group["pre_b"])] if group else [])

    one, groups = fold(parts)
    keep = ("first", "pre_a", "pre_b", "suf_a", "suf_b", "ok")
    for _ in range(20):
        other, found = tree(parts)
        assert {k: one[k] for k in keep} == {k: other[k] for k in keep}
        assert sorted(found) == sorted(groups)
    a, b = pair.tokens(text)
    total = len(one["pre_a"]) + sum(len(g[1]) for g in groups) + sum(len(x[1]) for x in closed(parts))
    assert total <= a.nbytes and one["suf_a"] == b"" == one["suf_b"]
    assert sum(len(p["a"]) for p in parts) + len(one["pre_a"]) + sum(len(g[1]) for g in groups) == a.nbytes
