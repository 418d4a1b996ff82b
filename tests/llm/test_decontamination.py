"""The index against plain search, and the operator against a plain reading of its contract."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import decontamination as D
from tideline.llm.fmindex import FmIndex
from tideline.llm.queries import QUERIES

DOCS = "doc_id bigint, text string"
ITEMS = "item_id bigint, text string"


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[0-9a-z\x80-\U0010ffff]+", lower)


def plain(docs, items, window):
    """(key, words, spans, items) per document."""
    phrases = {}
    for name, text in items:
        w = plain_words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(name)
    out = []
    for key, text in docs:
        w = plain_words(text)
        hit, names = set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(w) - size + 1):
                if (found := phrases.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    names |= {str(x) for x in found if x is not None}
        spans = []
        for k in sorted(hit):
            if spans and spans[-1][1] == k:
                spans[-1] = (spans[-1][0], k + 1)
            else:
                spans.append((k, k + 1))
        out.append((key, len(w), tuple(spans), tuple(sorted(names))))
    return sorted(out, key=str)


def got(df, key="doc_id"):
    rows = df.select(key, "n_words", "spans", "item_ids").collect()
    return sorted(((r[0], r.n_words, tuple((s.begin, s.end) for s in r.spans), tuple(r.item_ids)) for r in rows), key=str)


def corpus(seed, words=6, docs=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Éa", "Öl9", "日本"]

    def prose(n):
        return "".join(draw.choice(vocabulary).upper() + draw.choice([" ", "\n", "--", ", ", "\x00"]) for _ in range(n))

    items = [(i % 7, prose(draw.randint(0, 9))) for i in range(12)] + [(None, prose(6)), (20, None), (21, "w1"), (22, "!!")]
    texts = [prose(draw.randint(0, 40)) for _ in range(docs)] + [prose(400), None, "", "?!", items[0][1], items[3][1] * 5]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[4]), (None, texts[5])]
    return rows, items


def test_index_against_plain_search():
    rng = np.random.default_rng(5)
    for trial in range(60):
        symbols = int(rng.integers(1, 7))
        pieces = [rng.integers(1, symbols + 1, int(rng.integers(0, 40))) for _ in range(int(rng.integers(1, 7)))]
        pieces += pieces[:2] * (trial % 3)
        index = FmIndex(**FmIndex.build(pieces, symbols, rate=int(rng.integers(1, 9))))
        asked = [rng.integers(0, symbols + 1, n) for n in (1, 2, 3, 6) for _ in range(6)]
        lines = np.full((len(asked), 6), -1)
        for line, phrase in zip(lines, asked):
            line[6 - len(phrase) :] = phrase
        for phrase, a, b in zip(asked, *index.search(lines)):
            want = [
                int(start) + i
                for start, piece in zip(index.starts, pieces)
                for i in range(len(piece) - len(phrase) + 1)
                if (piece[i : i + len(phrase)] == phrase).all()
            ]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == sorted(want)


@pytest.mark.parametrize("window, shard_words, block", [(4, 1 << 20, 200_000), (4, 7, 5), (1, 3, 3), (9, 30, 2)])
def test_against_plain(spark, window, shard_words, block):
    docs, items = corpus(window)
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    found = D.decontaminate(df, spark.createDataFrame(items, ITEMS), window, shard_words=shard_words, block_phrases=block)
    assert got(found) == plain(docs, items, window)


def test_one_phrase_everywhere(spark):
    docs = [(i, "all rights reserved by w%d" % (i % 3)) for i in range(300)]
    items = [(i, "All Rights reserved.") for i in range(50)] + [(99, "by w1")]
    found = D.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got(found) == plain(docs, items, 10)


def test_removal(spark):
    docs, items = corpus(3)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], DOCS)
    found = D.decontaminate(df, spark.createDataFrame(items, ITEMS), 3).select("doc_id", "spans")
    rows = df.join(found, "doc_id").select("text", "spans", D.without(F.col("text"), F.col("spans")).alias("left")).collect()
    for r in rows:
        words, gone = plain_words(r.text), {k for s in r.spans for k in range(s.begin, s.end)}
        if not r.spans:
            assert r.left == r.text
        # What surrounds a span may stand side by side afterwards.
        assert "".join(plain_words(r.left)) == "".join(w for k, w in enumerate(words) if k not in gone)


def test_empty_tables_and_other_columns(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c")], ITEMS)
    some = spark.createDataFrame([(1, "x a b c y", 5, 6, "z")], "doc_id int, text string, part int, document int, spans string")
    assert D.decontaminate(none, items).collect() == []
    assert got(D.decontaminate(some, spark.createDataFrame([], ITEMS))) == [(1, 5, (), ())]
    assert got(D.decontaminate(some, items)) == [(1, 5, ((1, 4),), ("1",))]
    names = some.select(F.col("doc_id").alias("part"), F.col("text").alias("keys"))
    assert got(D.decontaminate(names, items, key="part", text="keys"), "part") == [(1, 5, ((1, 4),), ("1",))]
    with pytest.raises(ValueError):
        D.index(some, window=0)


def test_query(spark, write_tables):
    import hashlib

    docs, items = corpus(8)
    path = write_tables(documents=spark.createDataFrame(docs, DOCS), benchmark=spark.createDataFrame(items, ITEMS))
    rows = QUERIES["op13_fm_decontaminate"](spark, path).collect()
    want = [
        (k, n, sum(b - a for a, b in s), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(s))
        for k, n, s, names in plain(docs, items, 10)
    ]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
