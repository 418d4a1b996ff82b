"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text: shifted left by one, plus a random number for the byte,
so that it depends on the last ``WINDOW`` bytes only. A chunk ends at the end of a run of white space
where the hash falls below a limit. No chunk border depends on an earlier one, so an insertion changes
the chunks around it and all others stay. Passages of chunks are compared by digest.

What is looked for are passages: the fewest consecutive chunks from each chunk on, and up to each chunk,
that hold at least ``min_words`` words. A passage is repeated if a document of smaller id has it as a
whole, or the same document further up: the same bytes between chunk borders of both texts, and at the
start of both or of neither. Repeated passages are cut out of the text; together they cover the sequences
of that many words or more that an earlier text has in the same order, from the first border that both
texts have in them to the last. The first holder of a passage keeps it, and words that texts share by
chance, one here and one there, are left alone.

Passages are compared by 96 bits of their digest: of 6 · 10^12 of them, as 100 TB of text may hold, two
different ones agree with a chance of about 1 in 4000 in all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tideline.plans.scratch import freeze

WINDOW = 16
# A random number for each byte.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)], dtype=np.uint64)
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_ROWS = "digest bigint, check int, _id bigint, place bigint"
# Passages held by over one part in so many of all repeated ones are spread over so many salts.
_HOT, _SALTS = 10_000, 64


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the window instead of byte by byte."""
    h = GEAR[raw]
    reach = 1
    while reach < WINDOW and reach < len(h):
        wider = h.copy()
        wider[reach:] += h[:-reach] << np.uint64(reach)
        h, reach = wider, 2 * reach
    return h


def cut(raw: bytes, mean_words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks and the number of words that begin in each; one border in ``mean_words`` gaps."""
    if not raw:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)
    white = _WHITE[data]
    begins = ~white
    begins[1:] &= white[:-1]
    gaps = np.flatnonzero(begins)
    gaps = gaps[gaps > 0]
    ends = gaps[gear(data)[gaps - 1] < np.uint64((1 << 64) // mean_words)]
    ends = np.append(ends, len(raw))
    return ends, np.diff(np.concatenate([[0], np.cumsum(begins)[ends - 1]]))


def passages(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First chunks and ends (exclusive) of the passages: the shortest of ``min_words`` words from
    each chunk on, then the shortest up to each chunk that are not among those."""
    total = np.concatenate([[0], np.cumsum(words)])
    count = len(words)
    first = np.arange(count)
    after = np.searchsorted(total, total[:-1] + min_words, side="left")
    first, after = first[after <= count], after[after <= count]
    stop = np.arange(1, count + 1)
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    start, stop = start[start >= 0], stop[start >= 0]
    # Those from their first chunk on that are no longer than these have been listed.
    fresh = total[stop - 1] - total[start] >= min_words
    fresh |= start == stop
    return np.concatenate([first, start[fresh]]), np.concatenate([after, stop[fresh]])


def _passages(text: str | None, mean_words: int, min_words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 text, its chunk ends, words per chunk, and first chunks, ends and digests (two halves) of its passages."""
    raw = text.encode() if text else b""
    ends, words = cut(raw, mean_words)
    edges = np.concatenate([[0], ends])
    first, after = passages(words, min_words)
    # Borders near the start of a text lack the bytes before: what begins there is known from starts only.
    digests = b"".join(xxhash.xxh3_128_digest(raw[a:b], 0 if a else 1) for a, b in zip(edges[first].tolist(), edges[after].tolist()))
    return raw, ends, words, first, after, np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)


def passage_rows(df: DataFrame, text: str, mean_words: int, min_words: int) -> DataFrame:
    """One row per passage of ``_id``, ``_mark``, ``text``: its digest and where it is.

    ``place`` has the document's 32-bit mark above and the passage's number below, so that few
    numbers are all that has to be moved of a passage; ``check`` has 32 more bits of the digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, texts = (batch.column(i) for i in range(3))
            at = 0
            while at < len(batch):
                rows, digests, size = [], [], 0
                # Bounded pieces, whatever the texts' lengths.
                while at < len(batch) and size < 4_000_000:
                    raw, _, _, _, _, found = _passages(texts[at].as_py(), mean_words, min_words)
                    rows.append((at, len(found)))
                    digests.append(found)
                    size += len(raw)
                    at += 1
                counts = [n for _, n in rows]
                row = pa.array(np.repeat([r for r, _ in rows], counts))
                numbers = np.concatenate([np.arange(n) for n in counts]).astype(np.int64)
                place = (marks.take(row).to_numpy().astype(np.int64) << 32) | numbers
                both = np.concatenate(digests)
                check = both[:, 1].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(check), ids.take(row), pa.array(place)], names=["digest", "check", "_id", "place"]
                )

    return df.select("_id", "_mark", F.col(text)).mapInArrow(run, _ROWS)


def held_elsewhere(df: DataFrame, text: str, mean_words: int, min_words: int) -> DataFrame:
    """``_id``, ``_mark`` and ``numbers``: the passages of a text that a document of smaller id has.

    Holders are put together per digest, combining before the shuffle, and only digests of several
    documents are kept. Passages then meet them by digest. A digest that holds a large part of all of
    these rows, of which there are at most ``_HOT``, is known to every task and spread over salts.
    """
    rows = passage_rows(df, text, mean_words, min_words)
    holders = rows.groupBy("digest", "check").agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.count(F.lit(1)).alias("n"))
    holders = freeze(holders.where("least < most").select("digest", "check", "least", "n"), "holders")
    total = holders.agg(F.sum("n").alias("n"))
    hot = holders.join(F.broadcast(total.select(F.col("n").alias("_all"))), F.col("n") * _HOT > F.col("_all")).select(
        "digest", "check", F.lit(True).alias("_hot")
    )
    hot = F.broadcast(hot)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id", "place"), F.lit(_SALTS))).otherwise(F.lit(0)).cast("int")
    asked = rows.join(hot, ["digest", "check"], "left").select("digest", "check", "_id", "place", salt.alias("_salt"))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = holders.join(hot, ["digest", "check"], "left").select("digest", "check", "least", F.explode(salts).alias("_salt"))
    later = asked.join(known, ["digest", "check", "_salt"]).where("_id > least")
    mark = F.shiftright("place", 32).cast("int").alias("_mark")
    number = F.col("place").bitwiseAND(F.lit(2**32 - 1)).cast("int")
    return later.groupBy("_id", mark).agg(F.collect_set(number).alias("numbers"))


def cut_out(text: str | None, numbers: Sequence[int], mean_words: int, min_words: int) -> tuple[str | None, list[dict]]:
    """The text without its repeated passages, and where these were."""
    if not text:
        return text, []
    raw, ends, words, first, after, digests = _passages(text, mean_words, min_words)
    known = np.zeros(len(first), dtype=bool)
    known[list(numbers)] = True
    if len(digests):
        # The same passage further up: any but the first place of a digest.
        _, where = np.unique(digests.copy().view("V16").ravel(), return_inverse=True)
        least = np.full(where.max() + 1, len(ends))
        np.minimum.at(least, where, first)
        known |= first > least[where]
    marks = np.zeros(len(ends) + 2, dtype=np.int64)
    np.add.at(marks, first[known], 1)
    np.add.at(marks, after[known], -1)
    repeated = np.cumsum(marks)[:-1] > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], repeated])))
    kept, spans, at = b"", [], 0
    edges = [0, *ends.tolist()]
    for first, after in zip(turns[::2].tolist(), turns[1::2].tolist()):
        kept += raw[at : edges[first]]
        at = edges[after]
        spans.append({"start": edges[first], "stop": at, "words": int(words[first:after].sum())})
    return ((kept + raw[at:]).decode(), spans) if spans else (text, [])


def dedup(
    df: DataFrame, key: str = "doc_id", text: str = "text", mean_words: int = 5, min_words: int = 12, out: str = "spans"
) -> DataFrame:
    """The rows with repeated passages cut out of ``text``, and ``spans`` that says where they were.

    ``spans`` has start and stop in bytes of the UTF-8 text and the words between; it is empty where
    nothing was cut. Null texts stay null. Rows with one key count as one document: nothing is cut
    out of one for being in another. A row without a key goes by its text. ``key`` is an integer.
    """
    kept = [c for c in df.columns if c != out]
    body = F.coalesce(text, F.lit(""))
    by_text = F.xxhash64(body).bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    marked = df.select(
        *kept, F.coalesce(F.col(key).cast("bigint"), by_text).alias("_id"), F.hash(F.lit(1), body).alias("_mark")
    )
    # About as many rows as there are texts, each of its own length: an ordinary join at every size.
    joined = marked.join(held_elsewhere(marked, text, mean_words, min_words), ["_id", "_mark"], "left")

    @F.pandas_udf("text string, spans array<struct<start:int,stop:int,words:int>>")
    def without(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows = [cut_out(t, n, mean_words, min_words) for t, n in zip(texts, numbers)]
        return pd.DataFrame(rows, columns=["text", "spans"])

    done = joined.withColumn("_new", without(F.col(text), F.coalesce("numbers", F.array().cast("array<int>"))))
    return done.select(*[F.col("_new.text").alias(text) if c == text else F.col(c) for c in kept], F.col("_new.spans").alias(out))
