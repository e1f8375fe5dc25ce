"""Elias-Fano sequences and an n-gram trie over them, held in one flat buffer that is a mapped file."""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Callable

import numpy as np

_WORD = np.uint64(64)
BLOCK = 1 << 15  # queries answered at a time, so that their working memory stays in the cache


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of a fixed width, packed in 64-bit words (one spare word at the end)."""
    out = np.zeros(len(values) * width // 64 + 2, dtype=np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << shift)
        over = np.flatnonzero(shift + np.uint64(width) > _WORD)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (_WORD - shift[over]))
    return out


def _read_bits(words: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), dtype=np.uint64)
    at = index.astype(np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((_WORD - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


def pack_sorted(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of unsigned numbers in Elias-Fano form, to be read whole."""
    values = values.astype(np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
    unary[ones] = 1
    high = np.packbits(unary, bitorder="little").tobytes()
    low = _pack_bits(values & np.uint64((1 << width) - 1), width).tobytes()[: -(-n * width // 8)]
    return struct.pack("<IBI", n, width, len(high)) + high + low


def unpack_sorted(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The sequence packed at that place, and the place after it."""
    n, width, size = struct.unpack_from("<IBI", blob, at)
    at += 9
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), bitorder="little"))[:n]
    at += size
    length = -(-n * width // 8)
    words = np.frombuffer(blob[at : at + length] + bytes(16 + -length % 8), dtype="<u8")
    high = (ones - np.arange(n)).astype(np.uint64) << np.uint64(width)
    return high | _read_bits(words, np.arange(n), width), at + length


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, places of ones found by counts per word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.ranks = n, width, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        low = _pack_bits((values & ((1 << width) - 1)).astype(np.uint64), width)
        ones = (values >> width) + np.arange(n)
        unary = np.zeros(((int(ones[-1]) if n else 0) // 64 + 1) * 64, dtype=np.uint8)
        unary[ones] = 1
        high = np.packbits(unary, bitorder="little").view("<u8").astype(np.uint64)
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        return cls(n, width, low, high, ranks)

    def at(self, index: np.ndarray) -> np.ndarray:
        """Values at an array of places."""
        return _in_blocks(self._at, index)

    def _at(self, index: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ranks, index, side="right") - 1
        left = index - self.ranks[word]
        bits = self.high[word]
        place = np.zeros(len(index), dtype=np.int64)
        for step in (32, 16, 8, 4, 2, 1):  # the place of the one with that rank in its word, by halving
            ones = np.bitwise_count(bits & np.uint64((1 << step) - 1)).astype(np.int64)
            beyond = left >= ones
            left -= ones * beyond
            move = beyond * np.int64(step)
            place += move
            bits >>= move.astype(np.uint64)
        return (word * 64 + place - index) << self.width | _read_bits(self.low, index, self.width).astype(np.int64)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], dtype=np.int64), self.low, self.high, self.ranks]

    @classmethod
    def over(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:])


def _in_blocks(f: Callable[..., np.ndarray], *arrays: np.ndarray) -> np.ndarray:
    n = len(arrays[0])
    if n <= BLOCK:
        return f(*arrays)
    return np.concatenate([f(*[a[i : i + BLOCK] for a in arrays]) for i in range(0, n, BLOCK)])


class Level:
    """Successors of each context: monotone pointers, context-relative ids made monotone, quantised values.

    An id is raised by the last raised id of the context before, so that all ids together don't decrease.
    ``codes`` are the quantised probabilities, ``backoffs`` the quantised weights with which an entry, as a
    context, passes on to the shorter context (none at the last level).
    """

    def __init__(self, pointers: EliasFano, ids: EliasFano, codes: np.ndarray, backoffs: np.ndarray) -> None:
        self.pointers, self.ids, self.codes, self.backoffs = pointers, ids, codes, backoffs

    @classmethod
    def of(cls, contexts: int, owner: np.ndarray, ids: np.ndarray, codes: np.ndarray | None = None) -> Level:
        """owner (the context's number) and ids in order of (owner, id), no pair twice."""
        ids = ids.astype(np.int64)
        pointers = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=contexts)))) if contexts else np.zeros(1, dtype=np.int64)
        new = np.ones(len(owner), dtype=bool)
        new[1:] = owner[1:] != owner[:-1]
        lasts = ids[np.flatnonzero(np.append(new[1:], True))] if len(ids) else ids
        base = np.concatenate(([0], np.cumsum(lasts)))[:-1][np.cumsum(new) - 1] if len(ids) else ids
        none = np.zeros(len(ids), dtype=np.uint16)
        return cls(EliasFano.of(pointers), EliasFano.of(ids + base), none if codes is None else codes, none.copy())

    def begin(self, context: np.ndarray) -> np.ndarray:
        return self.pointers.at(context)

    def find(self, context: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The entry of each id among its context's successors, by successor search; -1 if there is none, or for a negative context or id."""
        return _in_blocks(self._find, context, wanted)

    def _find(self, context: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(context), -1, dtype=np.int64)
        live = np.flatnonzero((context >= 0) & (wanted >= 0))
        if not len(live) or not self.ids.n:
            return out
        own, which = np.unique(context[live], return_inverse=True)  # each context's range is looked up once
        first, end = self.pointers.at(own), self.pointers.at(own + 1)
        base = np.where(first > 0, self.ids.at(np.maximum(first - 1, 0)), 0)
        lo, hi, want = first[which], end[which], wanted[live] + base[which]
        keep = lo < hi
        while True:
            live, lo, hi, want = live[keep], lo[keep], hi[keep], want[keep]
            if not len(live):
                return out
            mid = (lo + hi) >> 1
            got = self.ids.at(mid)
            hit = got == want
            out[live[hit]] = mid[hit]
            less = got < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            keep = (lo < hi) & ~hit


class Trie:
    """Levels 2 and up of an n-gram trie over word numbers 0 .. words - 1, and the words' own values.

    The successors at level 3 and up are numbered by their place among the successors of the context
    without its first word, so their ids are small. ``mapped`` puts all arrays in one mapped file.
    """

    def __init__(self, levels: list[Level], codes: np.ndarray, backoffs: np.ndarray) -> None:
        self.levels, self.codes, self.backoffs = levels, codes, backoffs

    @classmethod
    def build(cls, words: int, grams: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
        """grams[k]: (rows of k + 2 word numbers, codes), sorted by row; every row's prefix and suffix are a level lower."""
        keys: list[np.ndarray] = []

        def numbers(rows: np.ndarray) -> np.ndarray:
            at = rows[:, 0].astype(np.int64)
            for k in range(1, rows.shape[1]):
                at = np.searchsorted(keys[k - 1], at * words + rows[:, k])
            return at

        levels, starts = [], []
        for k, (rows, codes) in enumerate(grams):
            owner, ids = numbers(rows[:, :-1]), numbers(rows[:, 1:])
            if k:
                ids = ids - starts[k - 1][numbers(rows[:, 1:-1])]
            contexts = len(grams[k - 1][1]) if k else words
            keys.append(owner * words + rows[:, -1])
            starts.append(np.searchsorted(owner, np.arange(contexts + 1)))
            levels.append(Level.of(contexts, owner, ids, codes))
        none = np.zeros(words, dtype=np.uint16)
        return cls(levels, none, none.copy())

    def context(self, rows: np.ndarray) -> np.ndarray:
        """The number of a context: the word itself, or its entry."""
        return rows[:, 0] if rows.shape[1] == 1 else self.entry(rows)

    def entry(self, rows: np.ndarray) -> np.ndarray:
        """The entry of each n-gram (a row of word numbers) at its level, -1 if absent."""
        k = rows.shape[1] - 2
        before = self.context(rows[:, :-1])
        return self.longer(k, before, rows[:, 1] if k == 0 else self.entry(rows[:, 1:]), self.context(rows[:, 1:-1]) if k else None)

    def longer(self, k: int, before: np.ndarray, shorter: np.ndarray, middle: np.ndarray | None) -> np.ndarray:
        """Entries at level k of n-grams given by the number of their context, of the n-gram without its first word, and of the words between."""
        if k == 0:
            return self.levels[0].find(before, shorter)
        known = (shorter >= 0) & (middle >= 0)
        relative = np.full(len(shorter), -1, dtype=np.int64)
        relative[known] = shorter[known] - self.levels[k - 1].begin(middle[known])
        return self.levels[k].find(before, relative)

    def mapped(self, path: str | None = None) -> Trie:
        """The same trie over a mapped file: at the given path, or else a file in memory, which leaves nothing behind."""
        arrays = [self.codes, self.backoffs]
        for lv in self.levels:
            arrays += [*lv.pointers.arrays(), *lv.ids.arrays(), lv.codes, lv.backoffs]
        size = max(1, sum(-(-a.nbytes // 64) * 64 for a in arrays))
        fd = os.memfd_create("trie") if path is None else os.open(path, os.O_RDWR | os.O_CREAT | os.O_TRUNC, 0o600)
        try:
            os.ftruncate(fd, size)
            buffer = mmap.mmap(fd, size)
        finally:
            os.close(fd)
        at, views = 0, []
        for a in arrays:
            view = np.frombuffer(buffer, dtype=a.dtype, count=a.size, offset=at)
            view[:] = a
            views.append(view)
            at += -(-a.nbytes // 64) * 64
        levels = [Level(EliasFano.over(own[:4]), EliasFano.over(own[4:8]), own[8], own[9]) for own in (views[i : i + 10] for i in range(2, len(views), 10))]
        return Trie(levels, views[0], views[1])
