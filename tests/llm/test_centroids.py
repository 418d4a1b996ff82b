"""The outward scan against all distances, and the rounds against a plain version."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import centroids as C
from tideline.llm.queries import QUERIES


def test_scan_against_all_distances():
    rng = np.random.default_rng(3)
    for trial in range(40):
        size, k = int(rng.integers(1, 9)), int(rng.integers(1, 50))
        wide = [3, 200, 1 << 20][trial % 3]
        table = rng.integers(-wide, wide + 1, (k, size))
        table[k // 2 :] = table[: k - k // 2]  # equal centroids
        vectors = np.concatenate([rng.integers(-wide, wide + 1, (300, size)), table])
        want = ((vectors[:, None, :] - table[None, :, :]) ** 2).sum(axis=2)
        which, distance, computed = C.Search(table).nearest(vectors)
        assert (distance == want.min(axis=1)).all() and (which == want.argmin(axis=1)).all()
        assert computed <= len(vectors) * k


def test_bounds_reject():
    rng = np.random.default_rng(4)
    table = rng.normal(0, 60, (64, 16)).astype(np.int64) + rng.integers(-400, 400, (64, 1))
    vectors = table[rng.integers(0, 64, 2000)] + rng.integers(-20, 21, (2000, 16))
    *_, computed = C.Search(table).nearest(vectors)
    assert computed < 2000 * 64 / 8


def plain(rows, k, rounds, seed):
    """(id, cluster, distance) per row and the centroids, with Python numbers only."""
    names = sorted((key is None, hashlib.sha256(f"{seed}:{key}".encode()).hexdigest(), v) for key, v in rows)
    table = [list(v) for _, _, v in names[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(table))

    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        for i, members in groups.items():
            table[i] = [sum(x) // len(members) for x in zip(*members)]
    return [(key, near(v)[1], near(v)[0]) for key, v in rows], table


def numbers(n, size, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i * 3, tuple(map(int, rng.integers(-50, 50, size)))) for i in range(n)]
    return rows + [rows[0], rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1])] if n > 3 else rows


@pytest.mark.parametrize("n, k, rounds", [(80, 6, 3), (80, 1, 2), (3, 5, 2), (40, 7, 0)])
def test_cluster(spark, n, k, rounds):
    rows = numbers(n, 4)
    df = spark.createDataFrame([(a, list(v), 1, "x") for a, v in rows], "vec_id bigint, v array<bigint>, row int, vector string").repartition(3)
    placed, final = C.cluster(df, k, rounds, 2, vector="v")
    want, table = plain(rows, k, rounds, 2)
    assert final.tolist() == table and placed.columns == [*df.columns, "cluster", "distance"]
    got = placed.collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == sorted(want, key=str)
    assert all(r.row == 1 and r.vector == "x" for r in got)


def test_query(spark, write_tables):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 64)], 1) for i in range(70)]
    rows += [rows[5], (1000, rows[6][1], 2), (None, rows[7][1], 3), (2000, [1e3] * 64, 0)]
    bad = [(1, None, 0), (2, [], 0), (3, [1.0] * 63, 0), (4, [1.0] * 63 + [None], 0), (5, [math.nan] * 64, 0), (6, [1.0] * 63 + [-math.inf], 0)]
    path = write_tables(embeddings=spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, label int"))
    got = QUERIES["op11_centroids"](spark, path).collect()
    want, table = plain([(a, tuple(math.floor(256 * x) for x in v)) for a, v, _ in rows], 40, 5, 2)
    sums = {}
    for _, c, d in want:
        sums[c] = sums.get(c, 0) + d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in table]
    full = [(a, c, d, sums[c], sum(sums.values()), digests[c]) for a, c, d in want]
    assert sorted(map(tuple, got), key=str) == sorted(full, key=str)


def test_no_vectors(spark, write_tables):
    path = write_tables(embeddings=spark.createDataFrame([(1, None, 1)], "vec_id bigint, embedding array<float>, label int"))
    out = QUERIES["op11_centroids"](spark, path)
    assert out.collect() == [] and out.columns[:3] == ["vec_id", "cluster", "distance"]


def test_too_large(spark):
    df = spark.createDataFrame([(1, [1 << 40, 0])], "vec_id bigint, vector array<bigint>")
    with pytest.raises(Exception, match="would not fit"):
        C.cluster(df, 1, 1, 2)
    with pytest.raises(ValueError):
        C.cluster(df, 0, 1, 2)
    assert not df.select(C.usable(F.lit(None).cast("array<double>"), 2).alias("x")).where("x").collect()
