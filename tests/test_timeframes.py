"""Frames by time against plain sums over all rows, whole and cut."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest

from tideline.operators.timeframes import rolling_time

SCHEMA = "series_id string, ts timestamp, row_key bigint, value double, rolling_n string"
START = dt.datetime(2024, 1, 1)


def plain(rows, span):
    out = {}
    for s, t, k, _, _ in rows:
        seen = [v for s2, t2, _, v, _ in rows if s2 == s and v is not None and t is not None and t2 is not None and t - span <= t2 <= t]
        out[k] = (
            None if t is None else len(seen),
            statistics.fmean(seen) if seen else None,
            statistics.stdev(seen) if len(seen) > 1 else None,
            min(seen, default=None),
            max(seen, default=None),
        )
    return out


def check(got, want):
    assert got.keys() == want.keys()
    for k, numbers in want.items():
        for a, b in zip(got[k], numbers):
            assert (a is None) == (b is None), (k, got[k], numbers)
            assert a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7), (k, got[k], numbers)


def frames(df, span):
    out = rolling_time(df, span=span)
    assert out.columns == ["series_id", "ts", "row_key", "value", "rolling_n", "rolling_mean", "rolling_std", "rolling_min", "rolling_max"]
    rows = out.collect()
    assert len(rows) == len({r.row_key for r in rows})
    return {r.row_key: tuple(r[4:]) for r in rows}


@pytest.mark.parametrize("seconds", [60, 10**7])
def test_frames(limits, spark, seconds):
    draw = random.Random(seconds)
    rows = []
    for k in range(260):
        series = draw.choice(["a", "a", "a", "b", None])
        # A burst, ties, rows exactly a span apart, rows before the epoch, null values and times.
        t = START + dt.timedelta(seconds=draw.choice([draw.randint(0, 30), draw.randint(0, 4000), 60 * draw.randint(0, 90), -2 * 10**9]))
        rows.append((series, None if k % 61 == 0 else t, k, None if draw.random() < 0.1 else draw.choice([draw.gauss(1e6, 1), 1e6 + 5]), "x"))
    rows.append(("lone", START, 900, None, "x"))
    check(frames(spark.createDataFrame(rows, SCHEMA).repartition(4), dt.timedelta(seconds=seconds)), plain(rows, dt.timedelta(seconds=seconds)))


def test_nan_stays_in_its_frames(limits, spark):
    values = [1.0, 2.0, float("nan"), 4.0, 5.0, 6.0, 8.0]
    rows = [("a", START + dt.timedelta(seconds=i), i, v, "x") for i, v in enumerate(values)]
    got = frames(spark.createDataFrame(rows, SCHEMA), dt.timedelta(seconds=1))
    assert [math.isnan(got[i][1]) for i in range(7)] == [False, False, True, True, False, False, False]
    assert math.isnan(got[3][2]) and got[6][1] == 7.0


def test_empty_and_wrong(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rolling_time(empty).collect() == []
    with pytest.raises(ValueError, match="microsecond"):
        rolling_time(empty, span=dt.timedelta(0))
