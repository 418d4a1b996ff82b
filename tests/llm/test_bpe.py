"""Byte-level BPE against the public library, and the perfect hash against a dictionary."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from tideline.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
OURS = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(coded: bytes) -> list[int]:
    return np.frombuffer(coded, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("ab  \n\t\x1c\x85\xa0 'srtéñ²0９<|>#́中😀‍İß", max_size=60))
def test_same_tokens_as_the_library_and_back(text):
    coded = OURS.encode(text)
    assert ids(coded) == THEIRS.encode_ordinary(text)
    assert OURS.decode(coded) == text.encode()


def test_long_pre_tokens_and_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 10)
    small = bpe.Bpe(RANKS, public_tokenizers.PATTERN, OURS.table)
    for text in ("a" * 20_000, "xyz " * 3000, " ".join(f"word{i}q" for i in range(500))):
        assert ids(small.encode(text)) == THEIRS.encode_ordinary(text)


def test_perfect_hash_fills_every_slot():
    keys = [f"key {i}".encode() for i in range(3000)]
    table = bpe.PerfectHash.build(keys, range(3000))
    assert sorted(table.keys) == sorted(keys)
    assert table.find(keys).tolist() == list(range(3000))
    assert table.find([b"other", b"", b"key 3001"]).tolist() == [-1, -1, -1]
    assert bpe.PerfectHash.build([b"one"], [7]).find([b"one", b"two"]).tolist() == [7, -1]


def test_vocabulary_without_all_bytes():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Bpe({b"a": 0}, public_tokenizers.PATTERN)


def test_operator_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "héllo wörld", "x"), (1, "héllo wörld", "x"), (2, None, None), (3, "", "y"), (None, " \n", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, token_ids string")
    model = bpe.share(spark, RANKS, public_tokenizers.PATTERN)
    got = bpe.decode(bpe.encode(df, model), model).collect()
    assert len(got) == 5
    for row in got:
        assert ids(bytes(row.token_ids)) == THEIRS.encode_ordinary(row.text or "")
        assert bytes(row.decoded).decode() == (row.text or "")
    assert bpe.encode(df.limit(0), model).columns == df.columns


def test_query(spark, write_tables):
    rows = [(0, "Some text here."), (1, None), (2, ""), (3, "éé " * 50)]
    path = write_tables(documents=spark.createDataFrame(rows, "doc_id bigint, text string"))
    for row in queries.op10_byte_bpe(spark, path).collect():
        text = dict(rows)[row.doc_id] or ""
        want = THEIRS.encode_ordinary(text)
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
