"""Trees, likeness and the edited texts against plain Python."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tideline.llm import merkle, queries

TEXTS = ["", "a", "One. Two, three", "p1\np2\n\ns2 p1\n\n\ns3", "\n\n", "é😀x. y" * 3, "a.b.c." * 2000, "One. Two, three"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(text: str) -> str:
    return sha("".join(sha("".join(sha(p) for p in s.split("\n"))) for s in text.split("\n\n")))


def plain_likeness(a: str, b: str) -> float:
    x, y = (set(re.findall(merkle.CLAUSE, t)) for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def plain_edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_roots(spark):
    df = spark.createDataFrame([(t, "x") for t in [*TEXTS, None]], "text string, fingerprint string")
    got = [r.fingerprint for r in merkle.fingerprints(df).collect()]
    assert got == [plain_root(t or "") for t in [*TEXTS, None]]
    assert len(set(got)) == len(set(TEXTS))
    assert merkle.fingerprints(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("a\nb\n\nc", "a\nb\n\nc", []),
        ("a\nb\n\nc", "a\nX\n\nc", [(1, 2)]),
        ("a\n\nb\nc", "a\n\nb", [(2, 2)]),
        ("a", "a\n\nb\nc", [(2, 1), (2, 2)]),
        ("", "x", [(1, 1)]),
    ],
)
def test_changed_places(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(merkle.changed(merkle.tree(F.col("a")), merkle.tree(F.col("b")))).first()[0]
    assert [tuple(p) for p in got] == want


def test_followers_over_many_parts(spark):
    rows = [(i * 3 % 101, 0) for i in range(101)] + [(None, 0), (5, 1)]
    got = {(r.k, r.h): (r.next_k, r.next_h) for r in merkle.followers(spark.createDataFrame(rows, "k int, h int"), ["k", "h"]).collect()}
    down = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    assert got == dict(zip(down, down[1:] + down[:1]))


def run(spark, write_tables, rows):
    path = write_tables(documents=spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int, tree string"))
    return queries.op2_merkle_tree(spark, path).collect()


def test_query(spark, write_tables):
    rows = [(10 * i, t, 0, "") for i, t in enumerate(TEXTS)]
    got = run(spark, write_tables, rows)
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        text, following = texts[r.doc_id], texts.get(r.doc_id - 10, TEXTS[-1])
        edited = plain_edit(text, following)
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert (r.fingerprint, r.edited_fingerprint) == (plain_root(text), plain_root(edited))
        assert (r.near_edited, r.near_next) == (plain_likeness(text, edited), plain_likeness(text, following))
        assert (r.changed_section is None) == (text == edited)


def test_nulls_repeats_and_ties(spark, write_tables):
    rows = [(None, "n n n n", 0, ""), (2, "two two", 0, ""), (2, "two two", 0, ""), (2, "other 2", 0, ""), (1, None, 0, "")]
    got = run(spark, write_tables, rows)
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 0), ("2", 7), ("2", 7), ("2", 7), ("None", 7)]
    last = next(r for r in got if r.doc_id is None)
    assert last.edited_sha256 in {sha(plain_edit("n n n n", t)) for t in ("two two", "other 2")}
    assert len({(r.doc_id, r.edited_sha256) for r in got}) == 4


def test_one_document_and_none(spark, write_tables, tmp_path_factory):
    assert [r.edited_sha256 for r in run(spark, write_tables, [(1, "abcd", 0, "")])] == [sha("abab")]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert merkle.half_replaced(empty).collect() == []
