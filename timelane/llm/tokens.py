"""Token ids of whole texts by a public tokenizer's vocabulary file.

The vocabulary splits text before every space that stands before something else than white
space, so the pieces between those places can be encoded one by one and kept: most words of
a corpus are then a lookup. The result equals encoding the whole text (tests compare both).
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

KEPT_PIECES = 700_000
"""Pieces a Python worker remembers; others are encoded each time they occur."""
_LONGEST_KEPT = 48
_UNSAFE = re.compile(r" \s")
_CUT = re.compile(r" (?=\S)")
_LATIN_END = "ɐ"


class _Pieces(dict):
    """Ids of a piece with a space before it, as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer, first: "_Pieces | None" = None, kept: int = KEPT_PIECES):
        """``first``: the pieces without a space before them, if these have one."""
        super().__init__()
        self.tokenizer, self.lead, self.first = tokenizer, " " if first is not None else "", first
        self.kept = kept

    def __missing__(self, piece: str) -> bytes:
        above, line, below = piece.partition("\n")
        if line and above and below and not (above[-1].isspace() or below[0].isspace()):
            return self[above] + self._run(line) + (self if self.first is None else self.first)[below]
        body, mark = (piece[:-1], piece[-1]) if piece[-1:] in (".", ",") else (piece, "")
        if body.isalpha() and (body.isascii() or max(body) < _LATIN_END):
            # one run of letters is one unit of the vocabulary; a mark behind it is another
            ids = self[body] + self._run(mark) if mark else self._run(self.lead + body)
        else:
            ids = _packed(self.tokenizer.encode(self.lead + piece, add_special_tokens=False).ids)
        if len(self) < self.kept and len(piece) <= _LONGEST_KEPT:
            self[piece] = ids
        return ids

    def _run(self, run: str) -> bytes:
        mapped = "".join(map(_SHOWN.__getitem__, run.encode()))
        return _packed([t.id for t in self.tokenizer.model.tokenize(mapped)])


def _shown() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is
    printable in Latin-1, else the next unused one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


_SHOWN = _shown()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes whole texts with one vocabulary file of the byte-level kind."""

    def __init__(self, path: str, plain: bool = False, kept: int = KEPT_PIECES):
        """``plain``: strings of special tokens inside a text are ordinary text. ``kept``: how
        many pieces are remembered."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.first = _Pieces(self.tokenizer, None, kept)
        self.later = _Pieces(self.tokenizer, self.first, kept)

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text``, four little-endian bytes each."""
        if not text:
            return b""
        pieces = _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
        if not pieces[-1]:  # the space at the end is a unit of its own
            return self._whole(text)
        head = self.first[pieces[0]] if pieces[0] else b""
        return head + b"".join(map(self.later.__getitem__, pieces[1:]))

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=4)
def encoder(path: str, plain: bool = False, kept: int = KEPT_PIECES) -> Encoder:
    """One encoder a Python worker, file and reading of special strings."""
    return Encoder(path, plain, kept)


def forget_texts() -> None:
    """Give back what this Python worker remembers of texts, for passes that encode nothing."""
    encoder.cache_clear()
