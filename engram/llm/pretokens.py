"""Cut texts into short pieces of whole pre-tokens, and remember what was made of each piece.

The public pattern's matches end wherever white space begins, and within ASCII wherever letters, digits
and punctuation meet (but for an apostrophe before letters). Such places are found for many texts at once
in a byte array; a piece between two of them is one pre-token, or a few where it holds characters beyond
ASCII or an apostrophe. Pieces repeat (Zipf), so a worker remembers lately seen ones by 64-bit hash, in
arrays of a bounded number of bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np

from engram.llm.common import U64, byte_set, row_chunks, slice_hashes

#: Classes of bytes: 0 for other than ASCII, white space, letters, digits, punctuation (controls included).
OTHER, SPACE, LETTER, DIGIT, PUNCT = range(5)
CLASS = np.full(256, PUNCT, np.uint8)
CLASS[0x80:] = OTHER
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
CLASS[0x30:0x3A] = DIGIT
#: First bytes of the white space characters beyond ASCII.
_LEADS = byte_set({0xC2, 0xE1, 0xE2, 0xE3})
#: All white space characters beyond ASCII, as bytes.
_WIDE = [c.encode() for c in map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


def _white(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of white space, those of them beyond ASCII)."""
    wide = np.zeros(len(data), bool)
    lead = np.flatnonzero(_LEADS[data])
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        for c in _WIDE:
            at = lead
            for k, b in enumerate(c):
                at = at[padded[at + k] == b]
            for k in range(len(c)):
                wide[at + k] = True
    return (CLASS[data] == SPACE) | wide, wide


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first piece of each row and the total): pieces cover every byte of their row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    white, wide = _white(data)
    kind = CLASS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = np.zeros(n + 1, bool)  # white space begins here
    begins[1:n] = white[1:] & ~white[:-1]
    last = np.empty(n, bool)  # the last of a run of white space that something follows in its row
    last[:-1] = white[:-1] & ~white[1:]
    last[-1] = False
    last[edge[1:]] = False
    plain = last & ~wide
    # a run's last character stands alone, or with what follows if it is a space; runs with wide characters stay whole
    plain[1:] &= ~wide[:-1] | edge[1:n]
    start = begins | edge
    start[:n] |= plain
    start[1:] |= plain & (data != 0x20)
    ascii_pair = (kind[:-1] >= LETTER) & (kind[1:] >= LETTER) & (kind[:-1] != kind[1:])
    start[1:n] |= ascii_pair & ((data[:-1] != 0x27) | (kind[1:] != LETTER))
    starts = np.flatnonzero(start[:n])
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def pretokens(piece: bytes, pattern: Any) -> list[bytes]:
    """The public pattern's matches in a piece."""
    if piece.isascii() and 0x27 not in piece:
        return [piece]
    return [m.encode() for m in pattern.findall(piece.decode())]


class Memo:
    """Numbers for hashes, and rows of some ragged arrays for numbers; forgets everything beyond `limit` bytes."""

    def __init__(self, kinds: list[type], limit: int = 48 << 20, slots: int = 20):
        self.kinds, self.limit, self.shift = kinds, limit, U64(64 - slots)
        self.slots = 1 << slots
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.hashes = np.zeros(1024, U64)
        self.slot = np.zeros(self.slots, np.int32)
        self.sorted, self.order = np.zeros(0, U64), np.zeros(0, np.int64)
        self.flat = [np.zeros(1024, k) for k in self.kinds]
        self.ends = [np.zeros(1024, np.int32) for _ in self.kinds]

    def nbytes(self) -> int:
        return self.hashes.nbytes + 2 * self.sorted.nbytes + sum(x.nbytes for x in [*self.flat, *self.ends])

    def numbers(self, h: np.ndarray, make: Callable[[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
        """The number of each hash. make(first) returns, for the unknown hashes' first places in h, (values, sizes) of each array."""
        if self.nbytes() > self.limit:
            self.clear()
        found = self.slot[h >> self.shift]
        rest = np.flatnonzero(self.hashes[found] != h) if self.size else np.arange(len(h))
        if not len(rest):
            return found
        own, first, inverse = np.unique(h[rest], return_index=True, return_inverse=True)
        place = np.searchsorted(self.sorted, own)
        place[place == len(self.sorted)] = 0
        known = self.sorted[place] == own if len(self.sorted) else np.zeros(len(own), bool)
        number = np.empty(len(own), np.int64)
        number[known] = self.order[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            number[new] = self.size + np.arange(len(new))
            self._append(own[new], make(rest[first[new]]))
        found[rest] = number[inverse]
        return found

    def _append(self, h: np.ndarray, made: list[tuple[np.ndarray, np.ndarray]]) -> None:
        size = self.size + len(h)
        self.hashes = _room(self.hashes, size)
        self.hashes[self.size : size] = h
        for k, (values, sizes) in enumerate(made):
            base = int(self.ends[k][self.size - 1]) if self.size else 0
            self.ends[k] = _room(self.ends[k], size)
            self.ends[k][self.size : size] = base + np.cumsum(sizes)
            self.flat[k] = _room(self.flat[k], base + len(values))
            self.flat[k][base : base + len(values)] = values
        self.slot[h >> self.shift] = np.arange(self.size, size)
        self.size = size
        self.order = np.argsort(self.hashes[:size], kind="stable")
        self.sorted = self.hashes[self.order]

    def sizes(self, k: int, numbers: np.ndarray) -> np.ndarray:
        """How many values of array k each number has."""
        ends = self.ends[k]
        return ends[numbers] - np.where(numbers > 0, ends[numbers - 1], 0)

    def rows(self, k: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of array k for all numbers in a row, sizes)."""
        sizes = self.sizes(k, numbers)
        return ragged(self.flat[k], self.ends[k], sizes, numbers, True), sizes


def ragged(values: np.ndarray, ends: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, picked: bool = False) -> np.ndarray:
    """The values of the numbered rows, one after the other; rows end at `ends`. picked: sizes are those of the numbers already."""
    sizes = sizes if picked else sizes[numbers]
    at = np.repeat(ends[numbers] - np.cumsum(sizes), sizes)
    at += np.arange(len(at))
    return values[at]


def _room(x: np.ndarray, size: int) -> np.ndarray:
    if size <= len(x):
        return x
    out = np.zeros(max(size, len(x) + (len(x) >> 1)), x.dtype)
    out[: len(x)] = x
    return out


def by_row(sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Offsets of rows in values, from the pieces' sizes and the rows' first pieces."""
    return np.concatenate([[0], np.cumsum(sizes)])[bounds]


def numbers_of(memo: Memo, data: np.ndarray, offsets: np.ndarray, encode: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """(memo number of each piece, first piece of each row); encode(pieces) gives what is remembered of new ones."""
    parts: list[tuple[np.ndarray, ...]] = []
    first_piece, total = [np.zeros(1, np.int64)], 0
    for row, _, part, at in row_chunks(data, offsets):
        starts, ends, bounds = cut(part, at)
        parts.append((starts + offsets[row], ends + offsets[row], slice_hashes(part, starts, ends)))
        first_piece.append(bounds[1:] + total)
        total += len(starts)
    bounds = np.concatenate(first_piece)
    if not total:
        return np.zeros(0, np.int64), bounds
    starts, ends, h = (np.concatenate(x) for x in zip(*parts))

    def make(first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return encode([data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist())])

    return memo.numbers(h, make), bounds
