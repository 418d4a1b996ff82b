"""Benchmark decontamination: an FM-index per training shard, searched for the windows of the items.

Documents are cut into words and gathered, in the order of a partition, into shards of about
``shard_words`` words. Each shard is indexed once (``fmindex``) and the indexes are written. Every
``window`` consecutive words of an item are a phrase; a shorter item is one phrase. All distinct
phrases are searched backward in every shard, in blocks of bounded size; their occurrences are
located through sampled positions and merged into spans of words to be removed.

A document longer than a shard goes on in the next one, which repeats the last ``window - 1`` words.
Words are maximal runs of ASCII letters (A-Z are lower-cased) and digits and of characters from
U+0080 on. Null and empty texts have no words. Every row is a document of its own whatever its key;
items that share an id are one item; a phrase of an item without an id is removed but names none.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.fmindex import FmIndex
from tideline.plans.attach import attach
from tideline.plans.scratch import freeze, rows_of

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or bytes([c]).isalnum() else 32 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_SLICE = 1 << 20  # bytes of a text that are cut into words at a time
_PARTS = {"levels": pa.binary(), "firsts": pa.binary(), "counts": pa.binary(), "marks": pa.binary(), "samples": pa.binary(), "starts": pa.binary()}


def _words(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, those of about ``size`` bytes at a time."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


class _Shard:
    """What has been gathered for the next index."""

    def __init__(self) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = lambda: len(self.vocabulary) + 1
        self.pieces: list[np.ndarray] = []
        self.whose: list[tuple[int, int]] = []  # document and its first word here, per piece
        self.ended: list[tuple[int, object, int]] = []  # document, key, words
        self.open: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.open.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def close(self, document: int, first: int) -> None:
        if any(map(len, self.open)):
            self.pieces.append(np.concatenate(self.open))
            self.whose.append((document, first))
        self.open = []
        self.size += 1

    def row(self, part: int, kind: pa.DataType, rate: int) -> pa.RecordBatch:
        stored = FmIndex.build(self.pieces, len(self.vocabulary), rate)
        numbers, keys, n_words = zip(*self.ended) if self.ended else ((), (), ())
        long = pa.list_(pa.int64())
        columns = {
            "part": pa.array([part], pa.int32()),
            "documents": pa.array([numbers], long),
            "keys": pa.array([keys], pa.list_(kind)),
            "n_words": pa.array([n_words], long),
            "whose": pa.array([[d for d, _ in self.whose]], long),
            "first": pa.array([[f for _, f in self.whose]], long),
            "vocabulary": pa.array([b" ".join(self.vocabulary)], pa.binary()),
            "size": pa.array([stored["size"]], pa.int64()),
            **{name: pa.array([stored[name]], t) for name, t in _PARTS.items()},
        }
        return pa.RecordBatch.from_pydict(columns)


def index(docs: DataFrame, window: int, key: str = "doc_id", text: str = "text", shard_words: int = 1 << 20, rate: int = 16) -> DataFrame:
    """Indexes of all documents, one row per shard. A task holds one shard at a time."""
    if window < 1 or not window <= shard_words < 1 << 30:
        raise ValueError("window must be at least 1 and shard_words between window and 2^30")
    kept = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = kept.schema["key"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, document, arrow = TaskContext.get().partitionId(), _Shard(), -1, None
        for batch in batches:
            arrow = batch.schema.field("key").type
            for name, value in zip(batch["key"].to_pylist(), batch["text"]):
                document += 1
                n, first, tail = 0, 0, []
                for words in _words(value.as_py() or b"", min(_SLICE, 8 * shard_words)):
                    if shard.size >= shard_words:
                        # The next index begins with what phrases that lie across the cut need.
                        shard.close(document, first)
                        yield shard.row(part, arrow, rate)
                        shard, first = _Shard(), n - len(tail)
                        shard.add(tail)
                    shard.add(words)
                    n += len(words)
                    tail = (words if len(words) >= window else tail + words)[1 - window :] if window > 1 else []
                shard.close(document, first)
                shard.ended.append((document, name, n))
                if shard.size >= shard_words:
                    yield shard.row(part, arrow, rate)
                    shard = _Shard()
        if shard.ended:
            yield shard.row(part, arrow, rate)

    schema = (
        f"part int, documents array<bigint>, keys array<{kind}>, n_words array<bigint>, whose array<bigint>, "
        "first array<bigint>, vocabulary binary, size bigint, " + ", ".join(f"{name} binary" for name in _PARTS)
    )
    return kept.mapInArrow(build, schema)


def phrases(items: DataFrame, window: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """``phrase`` (words joined by a space) and ``item``: all windows of all items, each once."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    split = items.select(F.col(key).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    parts = F.transform(starts, lambda i: F.array_join(F.slice("words", i, window), " "))
    return split.select(F.explode(parts).alias("phrase"), "item").distinct()


def _classes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``phrase``, ``class``) and (``class``, ``item``): phrases of the same items share a class.

    A set of items is told by its size and two sums of hashes, 126 bits in all.
    """
    found = freeze(found, "phrases")

    def total(seed: int) -> Column:
        hashed = F.when(F.col("item").isNotNull(), F.pmod(F.xxhash64(F.lit(seed), "item"), F.lit(1 << 62)))
        return F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))

    signed = freeze(found.groupBy("phrase").agg(F.count("item").alias("n"), total(1).alias("a"), total(2).alias("b")), "signatures")
    keys = ["n", "a", "b"]
    chosen = signed.groupBy(*keys).agg(F.min("phrase").alias("phrase")).withColumn("class", F.monotonically_increasing_id())
    chosen = freeze(chosen, "classes")
    named = attach(signed, chosen.drop("phrase"), keys, row_bytes=64).select("phrase", "class")
    return named, found.where("item is not null").join(chosen, "phrase").select("class", "item")


def _as_block(rows: list) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words, the phrases as numbers of them aligned right, and the phrases' classes."""
    cut = [r["phrase"].encode().split(b" ") for r in rows]
    words = {w: i for i, w in enumerate(dict.fromkeys(w for p in cut for w in p))}
    lines = np.full((len(cut), max(map(len, cut))), -1, dtype=np.int64)
    for line, phrase in zip(lines, cut):
        line[len(line) - len(phrase) :] = [words[w] for w in phrase]
    return list(words), lines, np.array([r["class"] for r in rows], dtype=np.int64)


def _hits(shard: dict, block: tuple) -> list[dict]:
    """Per document of a shard: merged spans of words, and the classes of the phrases found."""
    words, lines, classes = block
    vocabulary = shard["vocabulary"].split(b" ") if shard["vocabulary"] else []
    known = dict(zip(vocabulary, range(1, len(vocabulary) + 1)))
    number = np.array([known.get(w, 0) for w in words] + [-1], dtype=np.int64)
    index = FmIndex(shard["size"], *[shard[name] for name in _PARTS])
    begin, end = index.search(number[lines])
    counts = end - begin
    which = np.repeat(np.arange(len(lines)), counts)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[which]
    at = index.locate(rows)
    if not len(at):
        return []
    order = np.argsort(at, kind="stable")
    at, which = at[order], which[order]
    piece = np.searchsorted(index.starts, at, side="right") - 1
    # A span ends where no earlier phrase reaches on; pieces never touch, borders lie between.
    reach = np.maximum.accumulate(at + (lines >= 0).sum(axis=1)[which])
    fresh = np.flatnonzero(np.concatenate([[True], at[1:] > reach[:-1]]))
    last = np.concatenate([fresh[1:], [len(at)]]) - 1
    whose = np.asarray(shard["whose"])
    offset = (np.asarray(shard["first"]) - index.starts)[piece[fresh]]
    spans = pd.DataFrame({"document": whose[piece[fresh]], "b": at[fresh] + offset, "e": reach[last] + offset})
    found = pd.DataFrame({"document": whose[piece], "class": classes[which]}).drop_duplicates()
    grouped = spans.groupby("document").agg(begins=("b", list), ends=("e", list))
    grouped["classes"] = found.groupby("document")["class"].agg(list)
    return grouped.reset_index().assign(part=shard["part"]).to_dict("records")


def occurrences(shards: DataFrame, named: DataFrame, block_phrases: int = 200_000) -> DataFrame:
    """``part``, ``document``, ``begins``, ``ends``, ``classes``: a row per shard, block and document hit.

    The phrases go to the shards in blocks of about ``block_phrases``; only a block is ever held whole.
    """
    spark = shards.sparkSession
    blocks = max(1, -(-rows_of(named) // block_phrases))
    schema = "part int, document bigint, begins array<bigint>, ends array<bigint>, classes array<bigint>"
    out = None
    for k in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(_as_block(rows))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    hits = _hits({name: batch[name][i].as_py() for name in batch.schema.names}, shared.value)
                    yield pa.RecordBatch.from_pylist(hits, pa_schema)

        long = pa.list_(pa.int64())
        pa_schema = pa.schema([("part", pa.int32()), ("document", pa.int64()), ("begins", long), ("ends", long), ("classes", long)])
        asked = shards.select("part", "whose", "first", "vocabulary", "size", *_PARTS)
        found = freeze(asked.mapInArrow(search, schema), "occurrences")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _merged(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch made one."""
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))
        return F.when((F.size(done) > 0) & (s["begin"] <= F.try_element_at(done, F.lit(-1))["end"]), grown).otherwise(F.concat(done, F.array(s)))

    # Spans of one block and shard are merged already; only several need another look.
    return F.aggregate(spans, none, step)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    shard_words: int = 1 << 20,
    block_phrases: int = 200_000,
) -> DataFrame:
    """One row per document: its key, ``n_words``, ``spans`` (words ``begin`` to ``end``, excluded, that
    lie in an occurrence of a phrase; sorted, merged) and ``item_ids`` (strings, sorted)."""
    shards = freeze(index(docs, window, key, text, shard_words), "shards")
    named, members = _classes(phrases(items, window, item_key, item_text))
    found = occurrences(shards, freeze(named, "named"), block_phrases)
    pairs = F.arrays_zip(F.col("begins").alias("begin"), F.col("ends").alias("end"))
    per = found.select("part", "document", pairs.alias("spans"), "classes").groupBy("part", "document").agg(
        F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("classes")).alias("classes")
    )
    spans = F.when(F.col("n") == 1, F.col("spans")).otherwise(_merged(F.array_sort("spans")))
    hits = freeze(per.select("part", "document", spans.alias("spans"), F.array_sort(F.array_distinct("classes")).alias("classes")), "hits")
    # Documents with the same phrases share the list of items, which is put together once.
    sets = hits.select("classes").distinct().withColumn("class", F.explode("classes")).join(members, "class")
    lists = freeze(sets.groupBy("classes").agg(F.array_sort(F.collect_set("item")).alias("item_ids")), "lists")
    long = lists.agg(F.max(8 * F.size("classes") + 16 * F.size("item_ids") + F.octet_length(F.array_join("item_ids", "")))).first()[0]
    hit = attach(hits, lists, ["classes"], "left", row_bytes=64 + (long or 0), frozen=True).select("part", "document", "spans", "item_ids")
    rows = shards.select("part", F.explode(F.arrays_zip("documents", "keys", "n_words")).alias("d"))
    joined = rows.select("part", F.col("d.documents").alias("document"), "d").join(hit, ["part", "document"], "left")
    return joined.select(
        F.col("d.keys").alias(key),
        F.col("d.n_words").alias("n_words"),
        F.coalesce("spans", F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def without(text: Column, spans: Column) -> Column:
    """A text without the words of ``spans``, from the first to the last of each, and with all else."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, pairs in zip(texts, cuts):
            if t and pairs is not None and len(pairs):
                places = [m.span() for m in _WORD.finditer(t)]
                for s in reversed(pairs):
                    t = t[: places[s["begin"]][0]] + t[places[s["end"] - 1][1] :]
            out.append(t)
        return pd.Series(out, dtype=object)

    return cut(text, spans)
