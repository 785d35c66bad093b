"""Token counts against the library itself."""

from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from timelane.llm.pieces import piece_encoder
from timelane.llm.token_counts import count_tokens, token_counter

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["</s>", "<s>", "▁", "  ", "\r\n", "\xa0", "　", " ", "\0", "é", "中文", "😀", "ﬁ", "2024", "the", " and"]
TEXT = st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=4), st.sampled_from(" \n\tab")), max_size=20).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_any_text_counts_as_the_library_counts(text):
    library = token_counter(PATH).vocabulary.model
    assert token_counter(PATH).count(text)[0] == len(library.encode(text))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_any_text_encodes_as_the_library_encodes(text):
    import numpy as np

    coder = piece_encoder(PATH)
    if text:
        assert np.frombuffer(coder.encode(" " + text), coder.kind).tolist() == coder.vocabulary.model.encode(text)


def test_proved_strings_are_one_token_inside_texts():
    counter, library = token_counter(PATH), SentencePieceProcessor(model_file=PATH)
    proved = counter.vocabulary.whole_strings()
    assert len(proved) > 30_000
    spaced = [s for s in proved if s[0] == " " and s.strip(" ")][:2000]
    assert library.encode("".join(spaced)[1:]) == [proved[s] for s in spaced]
    assert counter.count("".join(spaced)[1:]) == (len(spaced), len(spaced))


def test_mix_files_and_odd_rows(spark):
    rows = [("m", '{"format": "mix", "version": 2}', 1), ("m", '{"format": "mix", "version": 2}', 2), (None, "words", 3),
            ("none", None, 4), ("empty", "", 5), ("long", "all the words " * 50_000, 6)]
    mixes = spark.createDataFrame(rows, "mix string, text string, n_tokens int")
    library = SentencePieceProcessor(model_file=PATH)
    got = [(r["mix"], r["n_bytes"], r["n_tokens"]) for r in count_tokens(mixes, PATH).collect()]
    want = [(k, len((t or "").encode()), len(library.encode(t or ""))) for k, t, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert count_tokens(mixes.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        count_tokens(mixes.withColumnRenamed("mix", "n_whole"), PATH, key="n_whole")
