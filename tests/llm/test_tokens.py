"""Token counts against the library, in one piece and spliced."""

from __future__ import annotations

import pytest
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tideline.llm import queries, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SPEC = open(PATH, encoding="utf-8").read()
TINY = tokens.Counter(SPEC, chunk_chars=40, overlap_chars=8)


def want(text: str | None) -> int:
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=250) | st.text("ab  \n\t\x0b\x1c\x85\xa0 'srtéñ0９<|>̧́中😀İßΣσ", max_size=250))
def test_same_as_the_library(text):
    assert TINY.count(text) == want(text)
    assert TINY._by_word(text) == want(text)


@pytest.mark.parametrize(
    "text",
    ["a <|endoftext|> b<|endoftext|>c " * 40, "x" * 1000, "x" * 300 + " " + "y" * 300, "word " * 500, " " * 500, "a\n" * 50 + "b" * 90],
    ids=["special", "one word", "two words", "words", "white", "mixed"],
)
def test_splices(text):
    assert TINY.count(text) == want(text)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "_REMEMBERED", 5)
    counter = tokens.Counter(SPEC)
    for text in ("one two three four five six seven", "eight nine", "one two ten"):
        assert counter.count(text) == want(text)


def test_refuses_other_tokenizers_and_settings():
    with pytest.raises(ValueError, match="white space"):
        tokens.Counter(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    with pytest.raises(ValueError, match="chunk_chars"):
        tokens.Counter(SPEC, 10, 5)


def test_query_nulls_repeats_and_long_texts(spark, write_tables):
    rows = [(0, "Hello there, you."), (0, "Hello there, you."), (1, None), (2, ""), (None, "é à"), (3, "long words here. " * 9000)]
    path = write_tables(documents=spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted(queries.op8_token_counts(spark, path).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    assert [(r.doc_id, r.n_tokens) for r in got] == [(0, 5), (0, 5), (1, 0), (2, 0), (3, want(rows[-1][1])), (None, want("é à"))]
    assert [r.over_limit for r in got] == [False] * 4 + [True, False]
    assert [r.n_bytes for r in got] == [17, 17, 0, 0, 17 * 9000, 5]


def test_operator_on_no_rows_and_clashing_names(spark):
    counter = tokens.share(spark, PATH)
    df = spark.createDataFrame([("a b", "x")], "text string, n_tokens string")
    assert [r.n_tokens for r in tokens.count_tokens(df, counter).collect()] == [2]
    assert tokens.count_tokens(df.limit(0), counter).collect() == []
