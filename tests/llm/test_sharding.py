"""The lookup table against a plain filling by turns, and the assignment of rows."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from tideline.llm import sharding


def _number(*parts: str) -> int:
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:13], 16)


def plain_table(names: list[str], slots: int) -> dict[int, str]:
    owners: dict[int, str] = {}
    looked = dict.fromkeys(names, 0)
    while len(owners) < slots:
        for name in names:
            while len(owners) < slots:
                slot = (_number("offset", name) % slots + looked[name] * (_number("skip", name) % (slots - 1) + 1)) % slots
                looked[name] += 1
                if slot not in owners:
                    owners[slot] = name
                    break
    return owners


@pytest.mark.parametrize("shards, slots", [(1, 2), (3, 7), (5, 101), (12, 211)])
def test_table(spark, shards, slots):
    names = [f"s{i}" for i in range(shards)]
    got = {r.slot: r.shard for r in sharding.lookup_table(spark, names, slots).collect()}
    assert got == plain_table(names, slots)
    sizes = Counter(got.values()).values()
    assert max(sizes) - min(sizes) <= 1


def test_few_slots_move_when_a_shard_goes(spark):
    names = [f"s{i}" for i in range(10)]
    before, after = plain_table(names, 1009), plain_table(names[:-1], 1009)
    moved = sum(before[s] != after[s] for s in before if before[s] != "s9")
    assert moved < 0.1 * 1009


@pytest.mark.parametrize("shards, slots", [([], 7), (["a", "a"], 7), (["a", "b"], 8), (["a", "b"], 2), ([str(i) for i in range(1000)], 100_003)])
def test_refused(spark, shards, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, shards, slots)


def test_rows(spark, tmp_path):
    names, slots = ["a", "b", "c"], 31
    rows = [(1, "x", 9), (1, "y", 9), (2, None, None), (None, "x", 1), (None, "z", 1), (None, None, 1)] + [(i, "t", 0) for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, slot int")
    table = sharding.lookup_table(spark, names, slots)
    owners = plain_table(names, slots)
    out = sharding.assign(df, table, slots)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "slot", "shard"]
    for r in got:
        key = str(r.doc_id) if r.doc_id is not None else "text:" + (r.text or "")
        assert r.slot == _number(key) % slots and r.shard == owners[r.slot]
    sharding.write_shards(out, f"{tmp_path}/shards", 2)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)
    assert sharding.assign(df.limit(0), table, slots).collect() == []
