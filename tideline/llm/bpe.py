"""Byte-level BPE with two tiers: whole pre-tokens by a minimal perfect hash, the rest by merges.

Most pre-tokens of usual text are in the vocabulary. These are found in a table without gaps: one
hash picks a bucket, the bucket's displacement sends each of its keys to a slot of its own, and the
key stored there is compared, so that a foreign pre-token is never taken for a known one. A miss is
merged byte by byte: the parts form a linked list and a heap holds the adjacent pairs by rank, so n
bytes take O(n log n) steps however long a pre-token is.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
import unicodedata
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

# White space as Unicode has it; Python's own \s also takes the separators 1C to 1F.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Pre-tokens remembered by a worker. It forgets them all when full, which only costs time.
_REMEMBERED = 1_200_000
# Pre-tokens of texts that are looked up together.
_AT_ONCE = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots(hashes: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    """The place in 0 … n - 1 of a hash under a displacement."""
    with np.errstate(over="ignore"):
        x = hashes + moves.astype(np.uint64) * _MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


@dataclass
class PerfectHash:
    """A minimal perfect hash over distinct byte strings: ``n`` keys in ``n`` slots."""

    keys: list[bytes]  # by slot
    values: np.ndarray  # by slot
    hashes: np.ndarray  # by slot
    moves: np.ndarray  # by bucket; below zero: the slot itself, for buckets of one key

    @classmethod
    def build(cls, keys: Sequence[bytes], values: Sequence[int]) -> PerfectHash:
        n = len(keys)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) < n:
            raise ValueError("two keys are equal or share their 64-bit hash")
        buckets = max(1, n // 3)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        sizes = np.diff(starts)
        moves = np.zeros(buckets, dtype=np.int64)
        place = np.full(n, -1, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[starts[b] : starts[b + 1]]
            if len(members) < 2:
                break
            first = 0
            while place[members[0]] < 0:
                tries = np.arange(first, first + 64)
                slots = _slots(hashes[members][None, :], tries[:, None], n)
                good = free[slots].all(axis=1)
                for t in np.flatnonzero(good):
                    if len(set(slots[t].tolist())) == len(members):
                        place[members], moves[b] = slots[t], tries[t]
                        free[slots[t]] = False
                        break
                first += 64
        left = np.flatnonzero(free)
        alone = np.flatnonzero(place < 0)
        place[alone] = left
        moves[bucket[alone]] = -1 - left
        by_slot = np.argsort(place)
        return cls([keys[i] for i in by_slot], np.asarray(values)[by_slot], hashes[by_slot], moves)

    def find(self, asked: Sequence[bytes]) -> np.ndarray:
        """The value of each key, -1 for those that are not there."""
        n = len(self.keys)
        if not n or not len(asked):
            return np.full(len(asked), -1, dtype=np.int64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, asked), dtype=np.uint64, count=len(asked))
        moves = self.moves[(hashes % np.uint64(len(self.moves))).astype(np.int64)]
        slots = np.where(moves < 0, -1 - moves, _slots(hashes, np.maximum(moves, 0), n))
        out = np.where(self.hashes[slots] == hashes, self.values[slots], -1)
        for i in np.flatnonzero(out >= 0):
            if self.keys[slots[i]] != asked[i]:
                out[i] = -1
        return out


def byte_pairs(ranks: dict[bytes, int]) -> list[list[int]]:
    """The rank of every two bytes, -1 where they are no token."""
    table = [[-1] * 256 for _ in range(256)]
    for key, rank in ranks.items():
        if len(key) == 2:
            table[key[0]][key[1]] = rank
    return table


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[list[int]]) -> list[int]:
    """Tokens of a pre-token: always the adjacent pair of least rank, the leftmost of equals, is merged."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_of, push, pop = ranks.get, heapq.heappush, heapq.heappop
    # (rank, start, end) of two adjacent parts; stale if one of them has changed since.
    heap = [(rank, i, i + 2) for i, (a, b) in enumerate(zip(piece, piece[1:])) if (rank := pairs[a][b]) >= 0]
    heapq.heapify(heap)
    while heap:
        _, start, end = pop(heap)
        middle = after[start]
        if middle < 0 or middle >= n or after[middle] != end:
            continue
        after[start], after[middle] = end, -1
        if end < n:
            before[end] = start
            if (rank := rank_of(piece[start : after[end]])) is not None:
                push(heap, (rank, start, after[end]))
        if (left := before[start]) >= 0 and (rank := rank_of(piece[left:end])) is not None:
            push(heap, (rank, left, end))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


@dataclass
class Bpe:
    """A vocabulary of ranks with the pattern that cuts text into pre-tokens."""

    ranks: dict[bytes, int]
    pattern: str
    table: PerfectHash | None = None
    known: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if missing := [i for i in range(256) if bytes([i]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.table = self.table or PerfectHash.build(list(self.ranks), list(self.ranks.values()))
        self._prepare()

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern, "table": self.table}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, known={})
        self._prepare()

    def _prepare(self) -> None:
        pattern = self.pattern.replace("[^\\s", f"[^{_SPACE}").replace("\\S", f"[^{_SPACE}]").replace("\\s", f"[{_SPACE}]")
        self._any = regex.compile(pattern)
        narrow = pattern
        for name in "LN":
            members = "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] == name)
            # Inside a class the members alone, elsewhere a class of them.
            narrow = re.sub(rf"(\[[^\]]*)\\p\{{{name}\}}", lambda found: found[1] + members, narrow)  # noqa: B023
            narrow = narrow.replace(f"\\p{{{name}}}", f"[{members}]")
        # The standard library is faster and has no \\p; up to U+00FF the two patterns agree.
        self._narrow = None if re.search(r"\\[pP]|\(\?[>|#&R]", narrow) else re.compile(narrow)
        self._pairs = byte_pairs(self.ranks)
        self._bytes: np.ndarray | None = None

    def split(self, text: str) -> list[str]:
        if self._narrow is not None:
            try:
                text.encode("latin-1")
                return self._narrow.findall(text)
            except UnicodeEncodeError:
                pass
        return self._any.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Remember the tokens of pre-tokens."""
        fresh = list(pieces.difference(self.known))
        if len(self.known) + len(fresh) > _REMEMBERED:
            self.known.clear()
            fresh = list(pieces)
        raw = [p.encode() for p in fresh]
        for piece, key, value in zip(fresh, raw, self.table.find(raw).tolist()):
            ids = (value,) if value >= 0 else merge(key, self.ranks, self._pairs)
            self.known[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """The same for many texts; new pre-tokens of texts of ``_AT_ONCE`` pre-tokens are met at once."""
        out: list[bytes] = []
        waiting: list[list[str]] = []
        count = 0

        def done() -> None:
            self.learn(set().union(*waiting))
            out.extend(b"".join(map(self.known.__getitem__, pieces)) for pieces in waiting)
            waiting.clear()

        for text in texts:
            pieces = self.split(text) if text else []
            if len(pieces) > _REMEMBERED // 2:
                # Part by part, so that a huge text with ever new words stays within what is remembered.
                done()
                coded, count = [], 0
                for at in range(0, len(pieces), _REMEMBERED // 2):
                    part = pieces[at : at + _REMEMBERED // 2]
                    self.learn(set(part))
                    coded.append(b"".join(map(self.known.__getitem__, part)))
                out.append(b"".join(coded))
                continue
            if count + len(pieces) > _AT_ONCE:
                done()
                count = 0
            waiting.append(pieces)
            count += len(pieces)
        done()
        return out

    def decode(self, ids: bytes | None) -> bytes:
        if self._bytes is None:
            self._bytes = np.full(max(self.ranks.values()) + 1, b"", dtype=object)
            for key, rank in self.ranks.items():
                self._bytes[rank] = key
        return b"".join(self._bytes[np.frombuffer(ids or b"", dtype="<u4")].tolist())


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def share(spark: SparkSession, ranks: dict[bytes, int], pattern: str) -> Broadcast:
    """The vocabulary with its hash table, built once; its size is that of the vocabulary file."""
    return spark.sparkContext.broadcast(Bpe(ranks, pattern))


def encode(df: DataFrame, model: Broadcast, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the token ids of ``text`` as binary: little-endian unsigned 32-bit integers.

    A null or empty text has no tokens: an empty binary, never null.
    """

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.encode_all(texts), dtype=object)

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, model: Broadcast, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the tokens stand for; null ids give empty bytes. The bytes of a text are
    its UTF-8, so ``decode(encode(x))`` is ``x``."""

    @F.pandas_udf("binary")
    def run(codes: pd.Series) -> pd.Series:
        return pd.Series([model.value.decode(c) for c in codes], dtype=object)

    return df.withColumn(out, run(F.col(ids)))
