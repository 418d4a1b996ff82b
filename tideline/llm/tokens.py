"""Token counts of texts of any length under a public tokenizer that drops white space.

Such a tokenizer never lets a token reach across white space, nor do its normalizer's compositions:
white space is a starter that composes with nothing. So the place after a run of ASCII white space
is a stable boundary, which is checked on probes when a counter is made.

Texts up to ``chunk_chars`` are counted word by word, each distinct word encoded once by the
library. A longer text is encoded in overlapping chunks with offsets. Where two chunks meet, the
splice is put at a stable boundary at which both have a token begin; what the cuts did to the words
around them is left out that way. If the overlap has no such place it is widened, in the end to the
whole of what is not yet counted.
"""

from __future__ import annotations

import os
from bisect import bisect_left

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

_WHITE = frozenset(" \t\n\x0b\x0c\r")
# Words remembered by a worker. It forgets them all when full, which only costs time.
_REMEMBERED = 1_000_000
_PROBES = ("a b", "x1 'y z", "é à\tb", "no  more\n\nthan", "<|x|> y's")


class Counter:
    def __init__(self, spec: str, chunk_chars: int = 65_536, overlap_chars: int = 512):
        """``spec`` is the tokenizer's JSON; a chunk must be longer than two overlaps."""
        if not 0 < 2 * overlap_chars < chunk_chars:
            raise ValueError("chunk_chars must be above 2 * overlap_chars, and that above 0")
        self.spec, self.chunk, self.overlap = spec, chunk_chars, overlap_chars
        self._open()
        for probe in _PROBES:
            if len(self._encode(probe)) != sum(len(self._encode(word)) for word in probe.split()):
                raise ValueError("the tokenizer does not treat white space as a boundary")

    def __getstate__(self) -> dict:
        return {"spec": self.spec, "chunk": self.chunk, "overlap": self.overlap}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def _open(self) -> None:
        # Spark runs one task per core; the library's own threads would only get in the way.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(self.spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[bytes, int] = {}

    def _encode(self, text: str):
        return self.library.encode(text, add_special_tokens=False)

    def count(self, text: str | None) -> int:
        """Number of tokens; null counts as empty."""
        if not text:
            return 0
        return self._by_word(text) if len(text) <= self.chunk else self._spliced(text)

    def _by_word(self, text: str) -> int:
        words = text.encode().split()  # of bytes, this splits at ASCII white space only
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            pass
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(fresh) > _REMEMBERED:
            self.known.clear()
            fresh = list(dict.fromkeys(words))
        coded = self.library.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False)
        self.known.update(zip(fresh, map(len, coded)))
        return sum(map(self.known.__getitem__, words))

    def _starts(self, text: str, begin: int, end: int) -> list[int]:
        """Where the tokens of a chunk begin in the text."""
        return [begin + a for a, _ in self._encode(text[begin:end]).offsets]

    def _spliced(self, text: str) -> int:
        total, n = 0, len(text)
        counted = 0  # a stable boundary: all before it is in ``total``
        end = min(n, self.chunk)
        starts = self._starts(text, 0, end)
        while end < n:
            overlap = self.overlap
            while True:
                begin = max(counted, end - overlap)
                if begin == counted:
                    # Widened to all that is open: one chunk takes the place of the two.
                    end = min(n, end + max(self.chunk, end - counted))
                    starts = self._starts(text, counted, end)
                    break
                next_end = min(n, begin + self.chunk + overlap)
                following = self._starts(text, begin, next_end)
                place = self._boundary(text, starts, following, begin, end)
                if place is not None:
                    total += bisect_left(starts, place) - bisect_left(starts, counted)
                    counted, end, starts = place, next_end, following
                    break
                overlap *= 2
        return total + len(starts) - bisect_left(starts, counted)

    @staticmethod
    def _boundary(text: str, left: list[int], right: list[int], begin: int, end: int) -> int | None:
        """A stable boundary at which both chunks have a token begin."""
        ours = set(left[bisect_left(left, begin + 1) : bisect_left(left, end)])
        for place in right[: bisect_left(right, end)]:
            if place in ours and text[place - 1] in _WHITE and text[place] not in _WHITE:
                return place
        return None


def share(spark: SparkSession, path: str, chunk_chars: int = 65_536, overlap_chars: int = 512) -> Broadcast:
    """A counter for the tokenizer in the file, sent to the executors once; its size is the file's."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(Counter(file.read(), chunk_chars, overlap_chars))


def count_tokens(df: DataFrame, counter: Broadcast, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of ``text``: 0 for null, empty and all-white texts."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([counter.value.count(t) for t in texts], dtype="int64")

    return df.withColumn(out, run(F.col(text)))
