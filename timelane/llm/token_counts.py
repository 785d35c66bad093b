"""Token counts of whole texts: proved whole tokens counted directly, the rest merged."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from timelane.llm.pieces import SPACE, PieceVocabulary, Remembered, pre_tokens

_WHOLE = 1 << 40
"""Added to a count of tokens once per pre-token that was counted without a merge."""


class TokenCounter:
    """Counts tokens with one ``.model`` file.

    A pre-token that is a proved string (:meth:`PieceVocabulary.whole_strings`) is one token,
    whatever stands around it, and is never given to the library; all others are merged by it.
    """

    def __init__(self, path: str):
        self.vocabulary = v = PieceVocabulary(path)
        whole = v.whole_strings() if v.cuts else {}
        self.first = Remembered(lambda run: 1 + _WHOLE if run in whole else len(v.merge(run)))
        self.later = Remembered(
            lambda run: 1 + _WHOLE if f" {run}" in whole else len(v.merge(f" {run}")))
        self.line_end = len(v.merge("\n"))

    def count(self, text: str | None) -> tuple[int, int]:
        """(tokens, pre-tokens counted directly) of ``text``; null and empty have none."""
        if not text:
            return 0, 0
        if not self.vocabulary.cuts:
            return len(self.vocabulary.model.encode(text)), 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        total = -self.line_end
        for head, rest in pre_tokens(" " + text):  # the library puts one space in front
            total += self.line_end + sum(map(self.later.__getitem__, rest))
            if head is not None:
                total += self.first[head]
        return total % _WHOLE, total // _WHOLE


@lru_cache(maxsize=4)
def token_counter(path: str) -> TokenCounter:
    """One counter a Python worker and file."""
    return TokenCounter(path)


COUNTED = ("n_bytes", "n_tokens", "n_whole")


def count_tokens(mixes: DataFrame, vocabulary: str, key: str = "mix", text: str = "text") -> DataFrame:
    """Bytes and tokens of the saved text of each mix, as sentencepiece gives them.

    ``mixes``: ``key`` and the whole ``text`` of a mix file (:func:`write_mix_files` gives such
    rows); any table of texts will do. ``vocabulary`` is the path of a ``.model`` file that all
    executors see. One row per row of ``mixes``, rows with equal keys too: ``key``,
    ``n_bytes`` (UTF-8), ``n_tokens`` (without begin, end or added tokens; special
    strings inside a text are plain text) and ``n_whole`` (pre-tokens that were counted as one
    token by proof). A null or empty text has 0 of each; a null key stays; other columns,
    whatever their names, are not read. ``key`` must not be named like a result.

    The text is read once where it lies, without an exchange. A task holds one batch of texts and
    the pre-tokens it remembers; a text is cut, never shortened.
    """
    if key in COUNTED:
        raise ValueError(f"the key may not be named {key}")
    field = mixes.schema[key]
    schema = StructType([StructField(key, field.dataType), *[StructField(n, LongType()) for n in COUNTED]])

    def count(batches):
        counter = token_counter(vocabulary)
        for batch in batches:
            found = np.array([counter.count(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found[:, 0]), pa.array(found[:, 1])],
                names=[key, *COUNTED])

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    return mixes.select(key, text, size.alias("_size")).mapInArrow(count, schema)
