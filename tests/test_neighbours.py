"""Nearest vectors against all pairs, and how much is compared."""

from __future__ import annotations

import numpy as np
import pytest

from tideline.operators import neighbours
from tideline.operators.neighbours import METRICS, knn_join


def frame(spark, x, groups=None):
    rows = [(str(groups[i]) if groups is not None else "g", i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, row_key bigint, features array<double>")


def plain(a, b, ga, gb, k, metric):
    out = []
    for i, v in enumerate(a):
        if v is None:
            continue
        d = [(float(METRICS[metric](np.array([v]), np.array([w]))[0, 0]), j) for j, w in enumerate(b) if w is not None and ga[i] == gb[j]]
        out += [(str(ga[i]), i, r + 1, j, x) for r, (x, j) in enumerate(sorted(d)[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric", sorted(METRICS))
@pytest.mark.parametrize("k, block", [(3, 8), (7, 1000), (30, 5)])
def test_against_all_pairs(spark, limits, metric, k, block):
    rng = np.random.default_rng(k)
    b = [list(v) for v in rng.integers(0, 4, (60, 3))] + [list(v) for v in rng.normal(0, 3, (40, 3))] + [None]
    a = [list(v) for v in rng.normal(0, 3, (12, 3))] + b[:5] + [None, [100.0, 0.0, 0.0]]
    ga, gb = [i % 2 for i in range(len(a))], [int(i % 7 == 0) for i in range(len(b))]
    got = knn_join(frame(spark, a, ga), frame(spark, b, gb), k, ["series_id"], metric=metric, block=block)
    rows = sorted((r.series_id, r.row_key, r["rank"], r.neighbour, r.distance) for r in got.collect())
    want = plain(a, b, ga, gb, k, metric)
    assert [r[:4] for r in rows] == [w[:4] for w in want]
    assert np.allclose([r[4] for r in rows], [w[4] for w in want])


def test_bounds_prune(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(100 * i, 1, (60, 4)) for i in range(10)])
    df, counts = frame(spark, x), {}
    got = knn_join(df, df, 5, block=60, counts=counts).collect()
    assert len(got) == 5 * len(x)
    # About ten cells; of the pairs of different cells almost none is looked at.
    assert counts["home"] <= 60 and counts["away"] <= 40
    far = np.array([[r.distance for r in got if r.row_key == i][-1] for i in range(0, 600, 100)])
    assert (far < 20).all()


def test_merges_some_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_MERGE", 2)
    rng = np.random.default_rng(2)
    x = [list(v) for v in rng.normal(0, 1, (120, 2))]
    df = frame(spark, x)
    got = knn_join(df, df, 4, ["series_id"], block=9)
    rows = sorted((r.series_id, r.row_key, r["rank"], r.neighbour) for r in got.collect())
    assert rows == [w[:4] for w in plain(x, x, ["g"] * 120, ["g"] * 120, 4, "euclidean")]


def test_nothing_and_wrong(spark):
    none, some = frame(spark, []), frame(spark, [[1.0, 2.0], [3.0, 4.0]])
    assert knn_join(none, some, 2).collect() == [] and knn_join(some, none, 2).collect() == []
    assert len(knn_join(some, some, 5).collect()) == 4
    for wrong in ({"k": 0}, {"k": 1, "metric": "cosine"}):
        with pytest.raises(ValueError):
            knn_join(some, some, **wrong)


def test_approximate_recall(spark, limits):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(rng.normal(0, 4, 8), 1, (150, 8)) for _ in range(10)])
    x = [list(v) for v in x] + [list(x[0])] * 40 + [None]
    groups = [i % 2 for i in range(len(x))]
    df, counts = frame(spark, x, groups), {}
    asked = df.where("row_key % 50 = 0")
    found = knn_join(asked, df, 5, ["series_id"], exact=False, tables=8, probes=6, cell_rows=64, block=64, counts=counts).collect()
    want = {(r[1], r[3]): r[4] for r in plain(x, x, groups, groups, 5, "euclidean") if r[1] % 50 == 0}
    got = {(r.row_key, r.neighbour): r.distance for r in found}
    assert len(got) == len(found) and counts["probed"] > 0
    hits = [p for p in want if p in got]
    assert len(hits) >= 0.9 * len(want) and all(abs(got[p] - want[p]) < 1e-9 for p in hits)
    assert all(r["rank"] <= 5 for r in found)
    assert knn_join(asked, df.limit(0), 2, ["series_id"], exact=False).collect() == []


@pytest.mark.parametrize("n", [300, 600])
def test_copies_do_not_grow_where_nothing_prunes(spark, n):
    """A cell is far smaller than what a task holds; every vector has to look into almost all of them."""
    x = np.random.default_rng(n).normal(0, 1, (n, 24))
    df, counts = frame(spark, x), {}
    got = knn_join(df, df, 3, block=4, counts=counts).orderBy("row_key", "rank").toPandas()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert (got["neighbour"].to_numpy().reshape(n, 3) == want).all()
    np.testing.assert_allclose(got["distance"].to_numpy().reshape(n, 3), np.take_along_axis(d, want, axis=1))
    # Bundles of an eighth of the rows, asked by blocks of an eighth: each vector moves so many times whatever the table.
    assert counts["away"] <= 8 * 8
