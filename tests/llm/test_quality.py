"""Counts, divergences and verdicts against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tideline.llm import quality, queries

SCHEMA = "doc_id bigint, lang string, text string, n_words string, kept int"
SPACE = " \t\n\x0b\x0c\r"


def plain_counts(text: str | None, window: int = 5) -> tuple[int, ...]:
    text = text or ""
    words = [w for w in re.split(f"[{SPACE}]+", text) if w]
    windows = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    held = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if held[w] > 1 for k in range(window)}
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def plain_divergence(p: list[int], q: list[int]) -> float:
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    return sum(x / 2 * math.log2(2 * x / (x + y)) if x else 0 for x, y in zip(p, q)) + sum(y / 2 * math.log2(2 * y / (x + y)) if y else 0 for x, y in zip(p, q))


def texts() -> list[str | None]:
    draw = random.Random(4)
    vocabulary = ["the", "of", "Rain", "été", "x#y", "42", "straße.", "(and)", "😀", "a"]
    made = [draw.choice([" ", "\n", "\t", "  "]).join(draw.choices(vocabulary[: draw.randint(1, 10)], k=draw.randint(0, 120))) for _ in range(40)]
    return made + [None, "", " \n ", "one", "a b c d e a b c d e", "same line\nsame line\n\n\nsame line", "a " * 12, "\x0bq\x0cr", "w1 w2 " * 4000]


def test_counts(spark):
    rows = [(i, "en", t, "x", 1) for i, t in enumerate(texts())]
    got = quality.features(spark.createDataFrame(rows, SCHEMA), quality.Rules()).select("doc_id", "_f.*").collect()
    for r in got:
        text = rows[r.doc_id][2] or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(text), text[:80]
        sets = ("a-z", "A-Z", "0-9", f"{SPACE}", ".,;:!?'\"()\\-", "^\x00-\x7f")
        assert r.classes == [len(re.findall(f"[{s}]", text)) for s in sets] and r.chars == len(text)
        parts = [p for p in re.split(r"[^a-z\x80-\U0010ffff]+", text.lower()) if p]
        assert r.compared == len(parts) and r.common == [parts.count(w) for w in quality.COMMON_WORDS["en"]]


def test_divergence(spark):
    df = spark.createDataFrame([([1, 2, 0, 5], [3, 0, 4, 1]), ([1, 1, 0, 0], [0, 0, 1, 1]), ([2, 1, 0, 0], [4, 2, 0, 0]), ([0, 0], [1, 1])], "p array<bigint>, q array<bigint>")
    got = [r[0] for r in df.select(quality.divergence(df.p, df.q)).collect()]
    assert got[:3] == pytest.approx([plain_divergence([1, 2, 0, 5], [3, 0, 4, 1]), 1.0, 0.0]) and got[3] is None


def test_verdicts(spark, limits):
    clean = "The rain of the day was over and the two of us went on to the house in the hills, and that was it for now. "
    many = " ".join(f"Word{i} the of and to in is that for" for i in range(30))
    soup = " ".join(f"q{i}%%% ### $$${i}" for i in range(60))
    french = " ".join(f"mot{i} de la le et les des" for i in range(40))
    rows = [(i, "en", f"{clean} Number {i} of {many}"[: 900 + i], "", 0) for i in range(30)]
    rows += [(100, "en", soup, "", 0), (101, "en", french, "", 0), (102, "en", "too short", "", 0), (103, "en", "all the same words " * 30, "", 0)]
    rows += [(104, "xx", many, "", 0), (105, None, many, "", 0), (106, "en", None, "", 0), (107, "en", "a fine short text of ten words is not judged", "", 0)]
    rows += [rows[0], (None, "en", rows[1][2], None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    rules = quality.Rules(max_repeat_percent=95)
    kept = quality.keep_good(df, rules)
    assert kept.columns == df.columns
    got = Counter(tuple(r) for r in kept.collect())
    gone = {100, 101, 102, 103, 106}
    assert got == Counter(r for r in rows if r[0] not in gone)
    assert quality.keep_good(df.limit(0)).collect() == []


def test_query(spark, write_tables):
    rows = [(i, "en", t) for i, t in enumerate(texts())]
    path = write_tables(documents=spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    got = queries.op7_quality_rules(spark, path)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_divergence", "word_divergence", "kept"]
    for r in got.collect():
        n, *_, repeated = plain_counts(rows[r.doc_id][2])
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (r.base_failed and r.kept)
