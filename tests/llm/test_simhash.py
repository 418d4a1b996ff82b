"""Fingerprints, covering masks, links and components against brute force."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
import xxhash

from tideline.llm import queries, simhash
from tideline.llm.components import components


def plain_print(text: str | None, words: int = 3) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in lowered.encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64(s, 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(values: list[int], radius: int) -> dict[int, int]:
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(sorted(set(values)), 2):
        if ((a ^ b) % 2**64).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {v: find(v) for v in root}


TEXTS = ["", " \n\t", "One", "one two", "A b C d e f", "É\x0bx\x0cy ÀB c d", "w " * 5000, "a b c a b c a b c"]


@pytest.mark.parametrize("text", TEXTS + [None])
@pytest.mark.parametrize("words", [1, 3, 5])
def test_fingerprint(text, words, monkeypatch):
    want = plain_print(text, words)
    assert simhash.simhash(text, words) % 2**64 == want
    monkeypatch.setattr(simhash, "_BLOCK", 2)
    assert simhash.simhash(text, words) % 2**64 == want


def test_spark_hashes_shingles_alike(spark):
    got = spark.sql("select xxhash64('one two three') as h").first().h
    assert got % 2**64 == plain_print("One Two Three")


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("agreed", [0, 0x0F0F_00FF_1234_FFFF])
def test_every_small_difference_is_left_out_by_a_mask(radius, agreed):
    masks = simhash.cover(agreed, radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and all(m & agreed == agreed for m in masks)
    free = [i for i in range(64) if not agreed >> i & 1]
    for places in combinations(free, radius):
        difference = sum(1 << i for i in places)
        assert any(m & difference == 0 for m in masks)


def spread_out(rng, groups: int, members: int) -> list[int]:
    out = []
    for _ in range(groups):
        value = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(members):
            out.append(value)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                value ^= 1 << int(bit)
    return [v - 2**64 if v >> 63 else v for v in out]


@pytest.mark.parametrize("bucket_rows", [4096, 4])
def test_components_of_near_fingerprints(spark, bucket_rows):
    rng = np.random.default_rng(5)
    values = spread_out(rng, 12, 9) + spread_out(rng, 1, 150) + [0, 0, 1, 7, 255]
    rows = [(i if i % 11 else None, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id bigint, simhash bigint")
    got = simhash.near_components(df, 3, bucket_rows=bucket_rows).collect()
    roots = plain_roots(values, 3)
    least: dict[int, int] = {}
    for i, v in rows:
        if i is not None:
            least[roots[v]] = min(i, least.get(roots[v], i))
    assert sorted((str(r.doc_id), r.simhash, r.component_id) for r in got) == sorted((str(i), v, least.get(roots[v])) for i, v in rows)


def test_components_of_chains_stars_and_nothing(spark, limits):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_query(spark, write_tables):
    rows = [(5, "a b c d"), (9, "A B C D"), (3, None), (4, " "), (1, "other words are here"), (2, "x " * 3000), (2, "x " * 3000)]
    path = write_tables(documents=spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op5_simhash_near(spark, path).collect())
    ids = {5: 5, 9: 5, 3: 3, 4: 3, 1: 1, 2: 2}
    assert got == sorted((i, f"{plain_print(t):016x}", ids[i]) for i, t in rows)


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d", 1), (9, "A B C D", 2), (None, "a b c d", 0), (3, "z", 0), (3, "z", 0), (3, "z", 0), (None, "q r s", 7), (None, None, 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, simhash int")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(5, "a b c d", 1), (3, "z", 0), (None, "q r s", 7), (None, None, 8)], key=str)
    assert simhash.keep_one(df.limit(0)).collect() == []
