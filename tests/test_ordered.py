"""Ordered computations give the same rows whole or cut, and however rows are partitioned."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.plans import LastSeen, NextSeen, Running, attach, framed, freeze, quantiles, scan, smallest, with_position
from tideline.plans.sketches import merged, near_quantiles, rank_error, sketches


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {
            "g": rng.choice(["a", "b", "c"], size=300, p=[0.6, 0.39, 0.01]),
            "t": np.arange(300),
            "v": np.where(rng.random(300) < 0.4, np.nan, rng.integers(0, 50, 300)),
        }
    )
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df.repartition(5, "v"), pdf


def test_scan(limits, rows):
    df, pdf = rows
    out = scan(
        df, ["g"], ["t"],
        [Running(F.col("v"), "upto"), Running(F.col("v"), "before", inclusive=False), LastSeen(F.col("v"), "last"), NextSeen(F.col("v"), "next")],
    ).toPandas().sort_values("t").reset_index(drop=True)
    by = pdf.groupby("g")["v"]
    zeros = pdf.assign(v=pdf["v"].fillna(0)).groupby("g")["v"]
    np.testing.assert_allclose(out["upto"], zeros.cumsum())
    np.testing.assert_allclose(out["before"], zeros.cumsum() - pdf["v"].fillna(0))
    np.testing.assert_allclose(out["last"], by.ffill())
    np.testing.assert_allclose(out["next"], by.bfill())


def test_position_over_the_whole_table(limits, rows):
    df, _ = rows
    out = with_position(df, [], ["t"]).toPandas().sort_values("t")
    assert out["position"].tolist() == list(range(300))


def test_null_group_is_a_group(limits, spark):
    df = spark.createDataFrame([(None, i) for i in range(12)] + [("a", i) for i in range(12)], "g string, t int")
    out = with_position(df, ["g"], ["t"]).toPandas()
    assert len(out) == 24 and (out["position"] == out["t"]).all()


@pytest.mark.parametrize("before,after", [(0, 0), (3, 0), (0, 4), (2, 2), (20, 20)])
def test_framed(limits, rows, before, after):
    df, pdf = rows

    def build(d, w):
        return d.select("*", F.sum("t").over(w.rowsBetween(-before, after)).alias("s"), F.lag("t", before).over(w).alias("l"))

    out = framed(df, ["g"], ["t"], before, after, build).toPandas().sort_values("t").reset_index(drop=True)
    assert len(out) == 300
    for _, part in pdf.groupby("g"):
        t = part["t"].to_numpy()
        want = [t[max(0, i - before) : i + after + 1].sum() for i in range(len(t))]
        assert out.loc[part.index, "s"].tolist() == want
        lagged = [t[i - before] if i >= before else None for i in range(len(t))]
        assert [None if pd.isna(x) else int(x) for x in out.loc[part.index, "l"]] == lagged


def test_quantiles(limits, rows):
    df, pdf = rows
    out = quantiles(df, ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.95}).toPandas().set_index("g")
    want = pdf.groupby("g")["v"].quantile([0.1, 0.5, 0.95]).unstack()
    np.testing.assert_allclose(out.loc[want.index, ["lo", "mid", "hi"]], want)


def test_weighted_quantiles(limits, spark):
    df = spark.createDataFrame([("a", float(v), v) for v in range(1, 9)], "g string, v double, n int")
    out = quantiles(df, ["g"], "v", {"q": 0.3}, weight="n").first()["q"]
    assert out == pytest.approx(np.quantile(np.repeat(np.arange(1, 9), np.arange(1, 9)), 0.3))


def test_attach(limits, rows):
    df, pdf = rows
    means = df.groupBy("g").agg(F.avg("v").alias("m"))
    out = attach(df, means, ["g"]).toPandas()
    assert len(out) == 300
    want = pdf["g"].map(pdf.groupby("g")["v"].mean())
    np.testing.assert_allclose(out.sort_values("t")["m"], want)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partitioning_does_not_matter(limits, rows, parts):
    df, pdf = rows
    out = scan(df.repartition(parts, "t"), ["g"], ["t"], [Running(F.col("t"), "s")]).toPandas().sort_values("t")
    assert out["s"].tolist() == pdf.groupby("g")["t"].cumsum().tolist()


def test_frozen_table_knows_its_rows(spark):
    frozen = freeze(spark.range(17).withColumn("x", F.array("id")))
    assert frozen._tideline_rows == 17 and frozen.count() == 17
    assert frozen.schema["x"].dataType.simpleString() == "array<bigint>"


def test_smallest(limits, spark, monkeypatch):
    """Exactly the wanted rows, ties by key, with few bins so that ranges are closed in more than once."""
    monkeypatch.setattr(sys.modules["tideline.plans.smallest"], "_BINS", 4)
    rng = np.random.default_rng(4)
    held = {
        "spread": [*rng.exponential(1, 60), 1e12, float("inf")],
        "ties": [*[2.0] * 30, *[1.0] * 10, *[3.0] * 10],
        "equal": [0.5] * 20,
        "few": [3.0, 1.0],
        None: [*rng.normal(0, 1e-9, 25), None, float("nan")],
    }
    wanted = {"spread": 31, "ties": 25, "equal": 7, "few": 9, None: 26}
    rows = [(s, i, v) for s, vs in held.items() for i, v in enumerate(None if v is None else float(v) for v in vs)]
    df = spark.createDataFrame(rows, "s string, i int, v double").repartition(5)
    sizes = freeze(spark.createDataFrame(list(wanted.items()), "s string, h bigint"), "sizes")
    got = smallest(df, ["s"], "v", ["i"], sizes, "h", 62).collect()
    for s, h in wanted.items():
        there = sorted((float("inf") if v != v else v, i) for i, v in enumerate(held[s]) if v is not None)
        assert sorted(r.i for r in got if r.s == s) == sorted(i for _, i in there[:h])
    assert smallest(df.limit(0), ["s"], "v", ["i"], sizes, "h", 62).collect() == []


def test_smallest_sorts_little(spark):
    """Of a long group only a slice is ordered: no range partitioning of all rows."""
    spark.conf.set("spark.tideline.maxGroupRows", "100")
    try:
        df = spark.range(20_000).select(F.lit("s").alias("s"), F.col("id").alias("i"), F.rand(1).alias("v"))
        sizes = freeze(spark.createDataFrame([("s", 9_000)], "s string, h bigint"), "sizes")
        out = smallest(freeze(df, "values"), ["s"], "v", ["i"], sizes, "h", 20_000)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" not in plan
        kept = {r.i for r in out.collect()}
        least = {r.i for r in df.orderBy("v").limit(9_000).collect()}
        assert kept == least
    finally:
        spark.conf.unset("spark.tideline.maxGroupRows")


def test_sketches_merge(spark):
    df = spark.range(60_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"), (F.col("id") % 7).alias("part"),
        F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, float("nan")).otherwise(F.pow(F.col("id").cast("double"), 2)).alias("v"),
    )
    parts = sketches(df, ["g", "part"], "v")
    assert parts.count() == 21 and parts.agg(F.sum("n_values")).first()[0] == 48_000
    wanted = {"low": 0.1, "mid": 0.5, "high": 0.9}
    for got in (near_quantiles(merged(parts, ["g"]), ["g"], wanted), quantiles(df, ["g"], "v", wanted, exact=False)):
        rows = {r.g: r for r in got.collect()}
        assert set(rows) == {"a", "b", None}
        for name, q in wanted.items():
            for r in rows.values():
                assert abs(r[name] ** 0.5 / 60_000 - q) <= 2 * rank_error(400) + 1e-3
    assert 0.0132 < rank_error(200) < 0.0134


def test_sketches_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("c", float("nan"))], "g string, v double")
    got = {r.g: r.m for r in quantiles(df, ["g"], "v", {"m": 0.5}, exact=False).collect()}
    assert got == {"a": None, "b": 2.0, "c": None}
    assert quantiles(df.limit(0), ["g"], "v", {"m": 0.5}, exact=False).collect() == []
    with pytest.raises(ValueError, match="weight"):
        quantiles(df, ["g"], "v", {"m": 0.5}, weight="v", exact=False)
