"""Ids of whole texts by a sentencepiece vocabulary, one pre-token after another.

A merge joins neighbours whose strings together are in the vocabulary. Where no string of it has a
space behind another character, no merge crosses the place before a run of spaces, and where none
has a line end beside anything, none crosses a line end. Both are read from the vocabulary,
so the text may be cut there and each pre-token (a run of spaces and what follows it) merged alone.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

SPACE = "▁"
"""What the vocabulary's strings have in place of a space; in a text it is a space too."""
KEPT_PIECES = 450_000
"""Pre-tokens a Python worker remembers; others are merged each time they occur."""
_LONGEST_KEPT = 48
_RUNS = re.compile(" +[^ ]*|[^ ]+")


class PieceVocabulary:
    """One ``.model`` file: its strings, and how texts are cut before they are merged."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        shown = [self.model.id_to_piece(i) for i in range(self.size)]
        self.plain = {
            i: s.replace(SPACE, " ") for i, s in enumerate(shown)
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))
        }
        odd = "  ﬁ  ½ "
        self.cuts = (
            self.model.normalize(odd) == f" {odd}".replace(" ", SPACE)
            and not any(" " in s.lstrip(" ") or "\n" in s and len(s) > 1 for s in self.plain.values())
        )
        """Whether the conditions above hold; otherwise a text is one pre-token."""

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for."""
        return np.array([
            1 if self.model.is_byte(i) else len(self.plain.get(i, "").encode()) for i in range(self.size)
        ], np.int64)

    def merge(self, run: str) -> list[int]:
        """The ids of ``run``, which begins with a space or does not, as inside a longer text."""
        if len(run) > 1 and run[0] in (" ", SPACE):
            return self.model.encode(run[1:])  # the library puts one space in front of a text
        return self.model.encode("\n" + run)[2:]  # behind a line end no space is added

    def whole_strings(self) -> dict[str, int]:
        """The strings proved to be one token: merged as a pre-token they give their own id.

        All are merged here, once a worker. What holds for a pre-token holds in any text, as
        no merge crosses its ends.
        """
        spaced = [i for i, s in self.plain.items() if s[:1] == " "]
        other = [i for i, s in self.plain.items() if s[:1] != " "]
        found = self.model.encode([self.plain[i][1:] for i in spaced])
        proved = {self.plain[i]: i for i, ids in zip(spaced, found) if ids == [i]}
        found = self.model.encode(["\n" + self.plain[i] for i in other])
        return proved | {self.plain[i]: i for i, ids in zip(other, found) if ids[2:] == [i]}


def pre_tokens(text: str):
    """Cut ``text`` into (first, rest) per line: ``first`` has no space before it or is None,
    ``rest`` are runs that had one space before them, which is left out. Lines end at \\n."""
    for line in text.split("\n"):
        if "  " in line or line[-1:] == " ":
            runs = _RUNS.findall(line)
            head = None if runs[0][0] == " " else runs[0]
            yield head, [r[1:] for r in (runs if head is None else runs[1:])]
        else:
            head, *rest = line.split(" ")
            yield head or None, rest


class Remembered(dict):
    """What ``make`` gives for a run, remembered for as many runs as a worker may keep."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, run: str):
        value = self.make(run)
        if len(self) < KEPT_PIECES and len(run) <= _LONGEST_KEPT:
            self[run] = value
        return value


class PieceEncoder:
    """Encodes whole texts with one vocabulary file of the sentencepiece kind."""

    def __init__(self, path: str):
        self.vocabulary = v = PieceVocabulary(path)
        self.kind = np.dtype("<u2" if v.size <= 1 << 16 else "<u4")
        self.first = Remembered(lambda run: self._packed(v.merge(run)))
        self.later = Remembered(lambda run: self._packed(v.merge(" " + run)))
        self.line_end = self._packed(v.merge("\n"))

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as it stands, without a space put in front, ``kind`` each."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.vocabulary.cuts:
            return self._packed(self.vocabulary.merge(text)) if text else b""
        parts = []
        for n, (head, rest) in enumerate(pre_tokens(text)):
            if n:
                parts.append(self.line_end)
            if head is not None:
                parts.append(self.first[head])
            parts.extend(map(self.later.__getitem__, rest))
        return b"".join(parts)


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder a Python worker and file."""
    return PieceEncoder(path)
