"""Adaptive context-mixing range coder for token ids, on numpy arrays.

A frame codes the ids of some texts in blocks of BLOCK ids. Every block starts with fresh
models, has its own stream and its own checksum. Three models predict an id: of order 0, counts
of the block's ids on top of the frame's, made into a table again every REFRESH ids; of order 1
and order 2, the id that followed the last one and the last two ids, with a confidence. How far
each is trusted is mixed from counts per pair of confidences, which every block learns. Range
coding writes first which of the predictions holds, and then, if none does, the id by order 0.

The blocks of a frame run in step: each operation handles one id of every block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
BLOCKS = 1024
"""Blocks of a full frame."""
REFRESH = 512
SLOTS = 2048
"""Entries of the order 1 and order 2 tables of a block; contexts share them by a hash."""
GAIN = 24
BASE = 1 << 16
MOST_CELLS = 1 << 25
MAGIC = b"IDS1"

_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 40)
_W, _ONE, _SMALL = np.uint64(16), np.uint64(1), _BOTTOM - np.uint64(1)


class _Coder:
    """Range coders of many blocks side by side; writes, or reads if it is given streams."""

    def __init__(self, lanes: int, streams: list[np.ndarray] | None = None):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)
        self.sent: list[tuple[np.ndarray, np.ndarray]] = []
        self.code = None
        if streams is not None:
            size = np.array([len(s) for s in streams])
            self.words = np.concatenate([*streams, np.zeros(8, np.uint16)]).astype(np.uint64)
            self.at = np.cumsum(size) - size
            self.code = np.zeros(lanes, np.uint64)
            for _ in range(4):
                self.code = self.code << _W | self.words[self.at]
                self.at += 1

    def settle(self, n: int) -> None:
        """Move on the first ``n`` coders whose highest bits are settled or whose range is small."""
        low, span = self.low[:n], self.range[:n]
        lanes = np.flatnonzero(((low ^ (low + span)) < _TOP) | (span < _BOTTOM))
        while len(lanes):
            low, span = self.low.take(lanes), self.range.take(lanes)
            same = (low ^ (low + span)) < _TOP
            span = np.where(same, span, (~low + _ONE) & _SMALL)
            if self.code is not None:
                at = self.at.take(lanes)
                self.code[lanes] = self.code.take(lanes) << _W | self.words.take(at, mode="clip")
                self.at[lanes] = at + 1
            else:
                self.sent.append((lanes, (low >> np.uint64(48)).astype("<u2")))
            low, span = low << _W, span << _W
            self.low[lanes], self.range[lanes] = low, span
            more = ((low ^ (low + span)) < _TOP) | (span < _BOTTOM)
            if not more.any():
                return
            lanes = lanes[more]

    def streams(self) -> list[bytes]:
        """What each coder has written."""
        every = np.arange(len(self.low))
        for shift in (48, 32, 16, 0):
            self.sent.append((every, (self.low >> np.uint64(shift)).astype("<u2")))
        lane = np.concatenate([x for x, _ in self.sent])
        order = np.argsort(lane, kind="stable")
        words = np.concatenate([x for _, x in self.sent])[order]
        bound = np.searchsorted(lane[order], np.arange(len(self.low) + 1))
        return [words[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:])]


def _run(lengths: np.ndarray, base: np.ndarray, coder: _Coder, symbols: np.ndarray | None) -> np.ndarray:
    """Code the symbols [block, place], or read them when there are none. Only the last block
    may be shorter than the others."""
    lanes, size = len(lengths), len(base)
    reading = symbols is None
    out = np.zeros((int(lengths.max()), lanes), np.int64) if reading else np.ascontiguousarray(symbols.T)
    counts = np.tile(base.astype(np.uint32), (lanes, 1))
    table = np.zeros((lanes, size + 1), np.uint32)
    first = np.zeros(lanes * SLOTS, np.int32)  # (symbol + 1) * 4 + confidence
    second = np.zeros(lanes * SLOTS, np.int32)
    trust = np.tile(np.array([8, 4, 20, 0], np.uint64), lanes * 32)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    index = np.arange(lanes)
    slots, rows, cells, places = index * SLOTS, index * 128, index * size, index * (size + 1)
    counts, flat = counts.reshape(-1), table.reshape(-1)
    whole = np.zeros(lanes, np.uint64)
    none = np.uint64(0)
    for t in range(len(out)):
        if t % REFRESH == 0:
            np.cumsum(counts.reshape(lanes, size), axis=1, out=table[:, 1:])
            whole = table[:, size].astype(np.uint64)
        n = lanes if lengths[-1] > t else lanes - 1
        h = last[:n] * 40503
        a1 = slots[:n] + ((h ^ h >> 9) & SLOTS - 1)
        h += before[:n] * 2246822519 + 97
        a2 = slots[:n] + ((h ^ h >> 13) & SLOTS - 1)
        e1, e2 = first.take(a1), second.take(a2)
        k1, k2 = e1 & 3, e2 & 3
        c1, c2 = (e1 >> 2) - 1, (e2 >> 2) - 1
        alike = c1 == c2
        row = rows[:n] + ((k2 << 5) + (k1 << 3) + (alike << 2))
        f0, f2 = trust.take(row), trust.take(row + 2)
        f01 = f0 + np.where(alike, none, trust.take(row + 1))
        total = f01 + f2
        low, span = coder.low[:n], coder.range[:n]
        part = span // total
        if reading:
            value = np.minimum((coder.code[:n] - low) // part, total - _ONE)
            choice = (value >= f0).astype(np.int64) + (value >= f01)
            x = np.where(choice == 0, c2, c1).astype(np.int64)
        else:
            x = out[t, :n]
            choice = np.where(x == c2, 0, np.where(x == c1, 1, 2))
        rest = np.flatnonzero(choice == 2)
        begin = np.where(choice == 0, none, np.where(choice == 1, f0, f01))
        share = np.where(choice == 0, f0, np.where(choice == 1, f01 - f0, f2))
        low += begin * part
        np.multiply(share, part, out=span)
        if len(rest):
            # No prediction held: the id by order 0, inside of the range that says so.
            own, place = span.take(rest), places.take(rest)
            part = own // whole.take(rest)
            if reading:
                value = (coder.code.take(rest) - low.take(rest)) // part
                at = place
                step = 1 << max(size - 1, 1).bit_length()
                end = place + (size - 1)
                while step:  # last symbol that starts at the value or before it
                    to = np.minimum(at + step, end)
                    at = np.where(flat.take(to) <= value, to, at)
                    step >>= 1
                x[rest] = at - place
            else:
                at = place + x.take(rest)
            begin = flat.take(at).astype(np.uint64)
            low[rest] += begin * part
            span[rest] = (flat.take(at + 1) - begin) * part
        coder.settle(n)
        trust[row + choice] += np.uint64(GAIN)
        big = np.flatnonzero(total > np.uint64(4000))
        if len(big):
            for k in range(3):
                at = row.take(big) + k
                trust[at] = (trust.take(at) >> _ONE) + _ONE
        fresh = (x + 1 << 2).astype(np.int32)
        first[a1] = np.where(x == c1, e1 + (k1 < 3), np.where(k1 > 0, e1 - 1, fresh))
        second[a2] = np.where(x == c2, e2 + (k2 < 3), np.where(k2 > 0, e2 - 1, fresh))
        counts[cells[:n] + x] += np.uint32(GAIN)
        if reading:
            out[t, :n] = x
        before[:n], last[:n] = last[:n], x
    return out.T


def _groups(blocks: int, size: int) -> list[tuple[int, int]]:
    """Blocks that run in step, so many that their tables stay small."""
    each = max(16, MOST_CELLS // max(size, SLOTS))
    return [(a, min(a + each, blocks)) for a in range(0, blocks, each)]


def encode_frame(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A frame of the texts' ids: keys (long; the smallest one stands for null), lengths, all ids."""
    known, symbols, n = np.unique(ids, return_inverse=True, return_counts=True)
    level = np.round(8 * np.log2(np.maximum(n * (BASE / max(len(ids), 1)), 1))).astype(np.uint8)
    base = _base(level)
    blocks = -(-len(ids) // BLOCK)
    sizes = np.full(blocks, BLOCK)
    if blocks:
        sizes[-1] = len(ids) - BLOCK * (blocks - 1)
    padded = np.zeros(blocks * BLOCK, np.int64)
    padded[: len(ids)] = symbols
    padded = padded.reshape(blocks, BLOCK)
    streams: list[bytes] = []
    for a, b in _groups(blocks, len(known)):
        coder = _Coder(b - a)
        _run(sizes[a:b], base, coder, padded[a:b, : int(sizes[a:b].max())])
        streams += coder.streams()
    sums = [zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) for i in range(blocks)]
    head = zlib.compress(b"".join([
        keys.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), known.astype("<u4").tobytes(), level.tobytes(),
        sizes.astype("<u2").tobytes(), np.array(sums, "<u4").tobytes(),
        np.array([len(s) for s in streams], "<u4").tobytes(),
    ]))
    front = MAGIC + struct.pack("<5I", len(keys), len(known), blocks, len(head), zlib.crc32(head))
    return front + head + b"".join(streams)


def _base(level: np.ndarray) -> np.ndarray:
    return np.maximum(np.round(2.0 ** (level / 8)), 1).astype(np.int64)


def decode_frame(frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, lengths and ids of a frame; a wrong checksum is a ValueError."""
    if frame[:4] != MAGIC:
        raise ValueError("not a frame of ids")
    texts, size, blocks, length, check = struct.unpack_from("<5I", frame, 4)
    head = frame[24 : 24 + length]
    if zlib.crc32(head) != check:
        raise ValueError("the head of the frame is damaged")
    head = zlib.decompress(head)
    parts, at = [], 0
    for kind, n in (("<i8", texts), ("<u4", texts), ("<u4", size), ("u1", size), ("<u2", blocks), ("<u4", blocks), ("<u4", blocks)):
        parts.append(np.frombuffer(head, kind, n, at))
        at += parts[-1].nbytes
    keys, lengths, known, level, sizes, sums, bytes_ = parts
    sizes = sizes.astype(np.int64)
    ends = 24 + length + np.cumsum(bytes_.astype(np.int64))
    streams = [np.frombuffer(frame, "<u2", int(n) // 2, int(e - n)) for e, n in zip(ends, bytes_)]
    ids = []
    for a, b in _groups(blocks, size):
        found = known[_run(sizes[a:b], _base(level), _Coder(b - a, streams[a:b]), None)]
        for i in range(a, b):
            own = found[i - a, : sizes[i]]
            if zlib.crc32(own.astype("<u4").tobytes()) != sums[i]:
                raise ValueError(f"block {i} is damaged")
            ids.append(own)
    return keys, lengths, np.concatenate(ids) if ids else np.empty(0, "<u4")
