"""Chunk borders, repeated passages and what stays, against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tideline.llm import chunks, queries

SCHEMA = "doc_id bigint, text string, spans string, n int"


def plain_chunks(text: str, mean_words: int = 5) -> list[bytes]:
    raw = text.encode()
    out, start = [], 0
    for end in (m.end() for m in re.finditer(rb"[ \t-\r]+(?=[^ \t-\r])", raw)):
        last = raw[max(0, end - chunks.WINDOW) : end][::-1]
        if end > 0 and sum(int(chunks.GEAR[b]) << k for k, b in enumerate(last)) % 2**64 < 2**64 // mean_words:
            out.append(raw[start:end])
            start = end
    return out + [raw[start:]] if raw else []


def plain_passages(parts: list[bytes], min_words: int) -> set[tuple[int, int]]:
    sizes, out = [len(p.split()) for p in parts], set()
    for i in range(len(parts)):
        ends = (b for b in range(i + 1, len(parts) + 1) if sum(sizes[i:b]) >= min_words)
        starts = (a for a in range(i, -1, -1) if sum(sizes[a : i + 1]) >= min_words)
        out |= {(i, b) for b in [next(ends, None)] if b is not None}
        out |= {(a, i + 1) for a in [next(starts, None)] if a is not None}
    return out


def plain_dedup(rows: list[tuple[int, str | None]], min_words: int = 12) -> list[str | None]:
    """Whole passages are compared, with the bytes themselves."""
    found, least = [], {}
    for key, text in rows:
        parts = plain_chunks(text or "")
        where = {(a, b): (a == 0, b"".join(parts[a:b])) for a, b in plain_passages(parts, min_words)}
        found.append((parts, where))
        for body in where.values():
            least[body] = min(key, least.get(body, key))
    out = []
    for (key, text), (parts, where) in zip(rows, found):
        gone, first = set(), {}
        for (a, _), body in where.items():
            first[body] = min(a, first.get(body, a))
        for (a, b), body in where.items():
            if least[body] < key or first[body] < a:
                gone |= set(range(a, b))
        out.append(text and b"".join(p for i, p in enumerate(parts) if i not in gone).decode())
    return out


def prose(draw: random.Random, words: int) -> str:
    out = ("".join(draw.choices("abcdeéß", k=draw.randint(1, 9))) for _ in range(words))
    return "".join(w + draw.choice([" ", " ", " ", "\n", ". ", " \t"]) for w in out)


def corpus() -> list[tuple[int, str | None]]:
    draw = random.Random(9)
    passage, line = prose(draw, 70), "A short line that is common to many. "
    rows = [(i, prose(draw, draw.randint(20, 200)) + line + (passage if i % 4 == 1 else "") + prose(draw, 30)) for i in range(24)]
    rows += [(50 + i, rows[i][1]) for i in range(3)]
    return rows + [(60, prose(draw, 40) + passage + prose(draw, 5) + passage), (61, None), (62, ""), (63, " \n"), (64, "short"), (65, "short"), (66, passage * 300), (67, "x" * 9000)]


@pytest.mark.parametrize("text", [t for _, t in corpus() if t][:30] + [" lead", "a", "a ", "\x0bé "])
def test_borders(text):
    raw = text.encode()
    ends, words = chunks.cut(raw)
    edges = [0, *ends.tolist()]
    assert [raw[a:b] for a, b in zip(edges, edges[1:])] == plain_chunks(text)
    assert words.sum() == len(raw.split())


def test_gear_by_doubling():
    raw = np.random.default_rng(1).integers(0, 256, 200, dtype=np.uint8)
    want = [sum(int(chunks.GEAR[b]) << k for k, b in enumerate(raw[max(0, i - chunks.WINDOW + 1) : i + 1][::-1])) % 2**64 for i in range(200)]
    assert chunks.gear(raw).tolist() == want


def test_insertion_moves_few_borders():
    text = prose(random.Random(3), 2000)
    before, after = set(plain_chunks(text)), set(plain_chunks(text[:3000] + "inserted words here " + text[3000:]))
    assert len(before - after) <= 4


def test_dedup(spark, limits):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA).repartition(5)
    out = chunks.dedup(df)
    assert out.columns == ["doc_id", "text", "n", "spans"]
    got = {r.doc_id: r for r in out.collect()}
    assert {k: got[k].text for k, _ in rows} == dict(zip([k for k, _ in rows], plain_dedup(rows)))
    for key, text in rows:
        cut_out = [(text or "").encode()[s.start : s.stop] for s in got[key].spans]
        assert sum(map(len, cut_out)) == len((text or "").encode()) - len((got[key].text or "").encode())
        assert [len(c.split()) for c in cut_out] == [s.words for s in got[key].spans]
    # Passages of 70 words go but for their first holder; others keep their text.
    assert all(got[k].spans for k in (5, 9, 13, 17, 21, 60, 66)) and not any(got[k].spans for k in (0, 1, 2, 3, 4, 6, 64, 65, 67))


@pytest.mark.parametrize("seed", range(3))
def test_patchworks(spark, seed):
    """Texts put together from pieces of one another, so that repeats begin and end anywhere."""
    draw = random.Random(seed)
    rows = [(0, prose(draw, 60))]
    for key in range(1, 50):
        pieces = []
        for _ in range(draw.randint(1, 4)):
            source = draw.choice(rows)[1]
            start = draw.randint(0, max(0, len(source) - 1))
            pieces.append(draw.choice([source[start : start + draw.randint(5, 300)], prose(draw, draw.randint(1, 25))]))
        rows.append((key, "".join(pieces)))
    draw.shuffle(rows)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: r.text for r in chunks.dedup(df).collect()}
    assert got == dict(zip([k for k, _ in rows], plain_dedup(rows)))
    assert sum(map(len, got.values())) < sum(len(t) for _, t in rows)


def test_digests_that_agree_in_part(spark, monkeypatch):
    """Passages that agree in the first half of the digest are still told apart."""
    real = chunks.xxhash.xxh3_128_digest
    monkeypatch.setattr(chunks.xxhash, "xxh3_128_digest", lambda raw, seed=0: bytes(8) + real(raw, seed)[8:])
    draw = random.Random(4)
    texts = [prose(draw, 50) for _ in range(3)]
    for t in texts:
        assert chunks.cut_out(t, [], 5, 12) == (t, [])
    twice = chunks.cut_out(texts[0] + texts[1] + texts[0], [], 5, 12)
    assert 30 <= sum(s["words"] for s in twice[1]) <= 55


def test_missing_and_repeated_keys(spark):
    text = prose(random.Random(1), 60)
    rows = [(None, text, "", 0), (7, text, "", 0), (7, text, "", 0), (7, text + "and more", "", 0), (None, None, "", 0)]
    got = Counter((r.doc_id, r.text) for r in chunks.dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got[(7, text)] == 2 and got[(7, text + "and more")] == 1 and got[(None, None)] == 1
    assert got[(None, "")] == 1
    assert chunks.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, write_tables):
    rows = corpus()
    path = write_tables(documents=spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id bigint, text string, source string"))
    got = {r.doc_id: r for r in queries.op3_gear_chunks(spark, path).collect()}
    assert {k: r.text for k, r in got.items()} == dict(zip([k for k, _ in rows], plain_dedup(rows)))
    assert all(r.n_cut_words == sum(s.words for s in r.spans) for r in got.values())


def test_chance_chunks_of_unrelated_texts_stay(spark):
    draw = random.Random(5)
    text = prose(draw, 120)
    # A chunk of 12 words would be a passage by itself.
    parts = [c.decode() for c in plain_chunks(text) if len(c.split()) < 12]
    # Every chunk is known from another text, no two in a row from the same one.
    spread = []
    for k, part in enumerate(parts):
        tried = (prose(draw, 9) + part + prose(draw, 9) for _ in range(5000))
        spread.append((k, next(t for t in tried if part.encode() in plain_chunks(t)[1:-1])))
    rows = [(k, t) for k, t in spread] + [(900, text), (901, prose(draw, 30) + text)]
    known = {c for _, t in spread for c in plain_chunks(t)}
    assert sum(len(p.split()) for p in parts if p.encode() in known) >= 50
    got = {r.doc_id: r for r in chunks.dedup(spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)).collect()}
    assert got[900].text == text and not got[900].spans
    assert sum(s.words for s in got[901].spans) >= 100
    assert plain_dedup(rows)[-2] == text


@pytest.mark.parametrize("seed", range(30))
def test_passages_cover_what_sequences_cover(seed):
    draw = random.Random(seed)
    words = [draw.randint(0, 9) for _ in range(draw.randint(0, 25))]
    first, after = chunks.passages(np.array(words, dtype=np.int64), 12)
    found = list(zip(first.tolist(), after.tolist()))
    assert len(found) == len(set(found)) and all(sum(words[a:b]) >= 12 for a, b in found)
    # Any sequence of enough words is covered by the passages that lie in it.
    for a in range(len(words)):
        for b in range(a + 1, len(words) + 1):
            covered = {k for x, y in found if a <= x and y <= b for k in range(x, y)}
            assert covered == (set(range(a, b)) if sum(words[a:b]) >= 12 else set())
