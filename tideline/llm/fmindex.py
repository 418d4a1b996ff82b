"""A full-text index over words: wavelet tree of the Burrows-Wheeler transform and sampled positions.

The text of a shard is its pieces of documents, each followed by a border of its own. Its suffixes
are sorted in full, borders before all words, so that runs of rows answer "which suffixes start with
these words", and the row of a suffix leads to the row of the one before it. Everything is an array:
many phrases are searched, and many rows located, at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_AT_ONCE = 1 << 18  # rows located at a time


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in sorted order; the last symbol must occur once.

    Ranks by the first symbols are joined to ranks by several times as many until no two are equal;
    only suffixes whose place is not settled are sorted again.
    """
    n = len(symbols)

    def packed(ranks: np.ndarray, at: np.ndarray | None, step: int, per: int, bits: int) -> np.ndarray:
        key = ranks.copy() if at is None else ranks[at]
        for k in range(1, per):
            shift = min(k * step, n)
            ahead = np.concatenate([ranks[shift:], np.zeros(shift, dtype=np.int64)])
            key = key << bits | (ahead if at is None else ahead[at])
        return key

    ranks = symbols.astype(np.int64)
    bits = max(1, int(ranks.max(initial=0)).bit_length())
    depth = 63 // bits
    key = packed(ranks, None, 1, depth, bits)
    order = np.argsort(key)
    places = np.arange(n)  # of the suffixes that are still to be sorted
    found = order
    bits = max(1, n.bit_length())
    per = max(2, 63 // bits)
    key = key[order]
    while True:
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        # The rank of a suffix is the place where its group begins.
        ranks[found] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        order[places] = found
        open_ = ~fresh
        open_[:-1] |= ~fresh[1:]
        if not open_.any():
            return order
        places, found = places[open_], found[open_]
        key = packed(ranks, found, depth, per, bits)
        by = np.argsort(key)
        found, key = found[by], key[by]
        depth *= per


@dataclass
class Bits:
    """A row of bits that counts the ones before a place."""

    words: np.ndarray  # 64 bits each, one word more than needed
    before: np.ndarray  # ones before each word

    @classmethod
    def of(cls, raw: np.ndarray) -> Bits:
        words = np.frombuffer(raw, dtype="<u8")
        return cls(words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))

    @staticmethod
    def pack(flags: np.ndarray) -> bytes:
        return np.packbits(flags, bitorder="little").tobytes().ljust((len(flags) // 64 + 1) * 8, b"\0")

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def ones(self, at: np.ndarray) -> np.ndarray:
        part = self.words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at >> 6] + np.bitwise_count(part)


class FmIndex:
    """Index of one shard. ``parts`` are what is stored; ``vocabulary`` numbers its words from 1."""

    def __init__(self, size: int, levels: bytes, firsts: bytes, counts: bytes, marks: bytes, samples: bytes, starts: bytes) -> None:
        self.size = size
        self.firsts = np.frombuffer(firsts, dtype="<i8")  # by symbol: its first row
        width = len(np.frombuffer(counts, dtype="<i8"))
        depth = max(1, (width - 1).bit_length())
        raw = np.frombuffer(levels, dtype=np.uint8).reshape(depth, -1)
        self.levels = [Bits.of(row) for row in raw]
        self.zeros = [size - int(level.ones(np.array([size]))[0]) for level in self.levels]
        # From where a symbol's places begin on the lowest level to where its rows begin.
        self.shift = self.firsts - np.frombuffer(counts, dtype="<i8")
        self.marks, self.samples = Bits.of(marks), np.frombuffer(samples, dtype="<u4")
        self.starts = np.frombuffer(starts, dtype="<i8")

    @staticmethod
    def build(pieces: Sequence[np.ndarray], symbols: int, rate: int = 16) -> dict[str, object]:
        """What is stored of the index over pieces of word numbers in 1 … ``symbols``."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        size = int(starts[-1])
        code = np.zeros(size, dtype=np.int64)
        inside = np.ones(size, dtype=bool)
        inside[starts[1:] - 1] = False
        code[inside] = np.concatenate(pieces) if len(pieces) else []
        unique = code + (len(pieces) - 1)
        unique[~inside] = np.arange(len(pieces))
        order = suffix_order(unique)
        seq = code[order - 1].astype(np.uint32)  # the symbol before each suffix; a border before the first
        counts = np.bincount(code, minlength=symbols + 1)
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        levels = []
        for bit in range(max(1, symbols.bit_length()) - 1, -1, -1):
            ones = (seq >> np.uint32(bit) & np.uint32(1)).astype(bool)
            levels.append(Bits.pack(ones))
            seq = np.concatenate([seq[~ones], seq[ones]])
        # Where each symbol begins on the last level.
        begins = np.zeros(symbols + 1, dtype=np.int64)
        fresh = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]])) if size else np.zeros(0, dtype=np.int64)
        begins[seq[fresh]] = fresh
        offset = np.arange(size) - np.repeat(starts[:-1], lengths + 1)
        marked = (offset % rate == 0)[order]
        return {
            "size": size,
            "levels": b"".join(levels),
            "firsts": firsts.astype("<i8").tobytes(),
            "counts": begins.astype("<i8").tobytes(),
            "marks": Bits.pack(marked),
            "samples": order[marked].astype("<u4").tobytes(),
            "starts": starts[:-1].astype("<i8").tobytes(),
        }

    def _before(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """First row, from ``row`` on, of the suffixes that start with ``symbol`` and go on like it."""
        depth = len(self.levels)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = level.ones(row)
            row = np.where(symbol >> (depth - 1 - k) & 1, zeros + ones, row - ones)
        return row + self.shift[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``from`` and ``to`` (excluded) of the suffixes that start with each phrase.

        ``phrases`` has one line of word numbers each, aligned right and filled with -1 on the left;
        a phrase with a 0 has a word that the shard lacks.
        """
        begin = np.zeros(len(phrases), dtype=np.int64)
        end = np.full(len(phrases), self.size, dtype=np.int64)
        end[(phrases == 0).any(axis=1)] = 0
        for k in range(phrases.shape[1] - 1, -1, -1):
            alive = np.flatnonzero((end > begin) & (phrases[:, k] > 0))
            symbol = phrases[alive, k]
            begin[alive] = self._before(symbol, begin[alive])
            end[alive] = self._before(symbol, end[alive])
        return begin, np.maximum(begin, end)

    def _previous(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one word longer; not asked where a piece begins."""
        symbol = np.zeros(len(row), dtype=np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            bit, ones = level.get(row), level.ones(row)
            symbol = symbol << 1 | bit
            row = np.where(bit, zeros + ones, row - ones)
        return row + self.shift[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of ``rows`` start."""
        out = np.empty(len(rows), dtype=np.int64)
        for at in range(0, len(rows), _AT_ONCE):
            row = rows[at : at + _AT_ONCE]
            left, steps = np.arange(at, at + len(row)), 0
            while len(left):
                here = self.marks.get(row)
                out[left[here]] = self.samples[self.marks.ones(row[here])].astype(np.int64) + steps
                left, row = left[~here], self._previous(row[~here])
                steps += 1
        return out
