import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.samples import odd_texts
from timelane.llm.tokens import Encoder
from timelane.llm.words import ALNUM_LOWER, SPACED, SPACED_LOWER, shingle_sums, word_slices


@pytest.mark.parametrize("rule, plain", [
    (SPACED, brute.spaced), (SPACED_LOWER, lambda t: brute.spaced(t, True)), (ALNUM_LOWER, brute.alnum)])
def test_words_and_hashes(rule, plain):
    texts = odd_texts() + ["A b", "a B"]
    seen = {}
    for at, to, words in word_slices(pa.array(texts), rule):
        h = words.hashes()
        for i in range(at, to):
            want = plain(texts[i])
            a, b = words.first[i - at], words.first[i - at + 1]
            got = [words.data[s:e].tobytes() for s, e in zip(words.start[a:b], words.end[a:b])]
            assert [g.translate(brute.LOWER) if rule != SPACED else g for g in got] == want
            for w, x in zip(want, h[a:b].tolist()):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_sliced_and_empty_columns():
    column = pa.array(["a b", None, "c", "d e f"]).slice(1, 3)
    assert [w.counts().tolist() for _, _, w in word_slices(column, SPACED)] == [[0, 1, 3]]
    assert list(word_slices(pa.array([], pa.string()), SPACED)) == []
    assert [w.counts().tolist() for _, _, w in word_slices(pa.array([None], pa.string()), SPACED)] == [[0]]


def test_shingle_sums_depend_on_the_words_alone():
    h = np.array([3, 5, 3, 5, 9], np.uint64)
    sums = shingle_sums(h)(np.arange(4), 2)
    assert sums[0] == sums[2] and len(set(sums.tolist())) == 3


def test_encoder_equals_the_tokenizer():
    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "word", "é", "ж", "1", "'s", ".", ",", "!", "<|endoftext|>", "\t", "\x1c", "\x85",
             "ﬁ", "'", "İ", "中", "word.\nword"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for t in [*texts, *[x for x in odd_texts() if x]]:
        want = np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert enc.encode(t) == want, t
    assert enc.encode(None) == b""
