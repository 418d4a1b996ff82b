from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators.missing import handle_missing
from tideline.operators.profile import box, class_balance, describe, fliers, histogram, missing, overview
from tideline.operators.rolling import add_features, first_rows, rolling_band, row_position, short_series, sliding_windows
from tideline.operators.scaling import Scaler, normalize

SIMPLE = {"s": list(range(10))}
GAPS = {"s": [0, 1, 2, None, 4, 5, 6, None, 8, 9]}


def values(df, column="value"):
    return [r[column] for r in df.orderBy("series_id", "ts", "row_key").collect()]


def test_interpolation_by_time(spark, limits):
    days = [1, 2, 5, 6, 9, 10]
    numbers = [None, 1.0, None, 3.0, None, None]
    rows = [("s", dt.datetime(2024, 1, d), d, v) for d, v in zip(days, numbers)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, row_key int, value double")
    assert values(handle_missing(df, ["value"])) == [1, 1, 2.5, 3, 3, 3]


def test_fills(series, limits):
    df = series(GAPS)
    assert values(handle_missing(df, ["value"]))[3] == 3 and values(handle_missing(df, ["value"]))[7] == 7
    assert values(handle_missing(df, ["value"], "ffill"))[3] == 2
    assert values(handle_missing(df, ["value"], "bfill"))[3] == 4
    assert handle_missing(df, ["value"], "drop").count() == 8
    assert values(handle_missing(series(SIMPLE), ["value"])) == list(range(10))


def test_fill_keeps_open_ends(series, limits):
    df = series({"s": [None, 1, None], "t": [None, None, None]})
    assert values(handle_missing(df, ["value"], "ffill")) == [None, 1, 1, None, None, None]
    assert values(handle_missing(df, ["value"], "bfill")) == [1, 1, None, None, None, None]
    assert values(handle_missing(df, ["value"])) == [1, 1, 1, None, None, None]


def test_unknown_options(series):
    with pytest.raises(ValueError):
        handle_missing(series(SIMPLE), ["value"], "median")
    with pytest.raises(ValueError):
        Scaler(["value"], "zscore")


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_scaling_and_back(series, limits, method):
    rng = np.random.default_rng(0)
    data = {"a": rng.normal(5, 2, 40).tolist(), "b": rng.uniform(-3, 3, 8).tolist(), "c": [4.0, 4.0, 4.0]}
    df = series(data)
    scaled, model = normalize(df, ["value"], method)
    got = {k: np.array(values(scaled.where(F.col("series_id") == k))) for k in data}
    for k, x in data.items():
        x = np.array(x)
        q1, mid, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        centre, spread = {"standard": (x.mean(), x.std()), "minmax": (x.min(), np.ptp(x)), "robust": (mid, q3 - q1)}[method]
        np.testing.assert_allclose(got[k], (x - centre) / (spread or 1), atol=1e-12)
    np.testing.assert_allclose(values(model.inverse_transform(scaled)), values(df), atol=1e-9)


def test_features(series, limits):
    rng = np.random.default_rng(1)
    x = rng.normal(size=80)
    out = add_features(series({"s": x.tolist(), "t": [1.0, 2.0]}), ["value"]).where("series_id = 's'").orderBy("ts").toPandas()
    s = pd.Series(x)
    for n in (7, 30):
        np.testing.assert_allclose(out[f"value_rolling_mean_{n}"], s.rolling(n, min_periods=1).mean())
        np.testing.assert_allclose(out[f"value_rolling_std_{n}"], s.rolling(n, min_periods=1).std())
    for k in (1, 7):
        np.testing.assert_allclose(out[f"value_lag_{k}"], s.shift(k))
    assert out["day_of_week"].tolist()[:8] == [0, 1, 2, 3, 4, 5, 6, 0] and out["month"].tolist()[30:32] == [1, 2]


def test_band(series, limits):
    x = [1.0, 2.0] * 20 + [50.0]
    out = rolling_band(series({"s": x})).orderBy("ts").toPandas()
    assert out["rolling_mean"].isna().sum() == 29
    assert out["outside_band"].tolist() == [False] * 40 + [True]


def test_windows(series, limits):
    rows = sliding_windows(series({"s": [1, 2, 3, 4, 5]}), ["value"], 3).orderBy("ts").collect()
    assert [r["window"] for r in rows] == [[[1], [2], [3]], [[2], [3], [4]], [[3], [4], [5]]]
    assert rows[0]["row_key"] == 2


@pytest.mark.parametrize("n,w,count", [(20, 5, 16), (10, 10, 1), (8, 1, 8), (100, 100, 1), (5, 10, 0)])
def test_window_counts(series, limits, n, w, count):
    assert sliding_windows(series({"s": range(n)}), ["value"], w).count() == count


def test_window_too_large(series):
    df = series({"s": range(5), "t": range(30)})
    with pytest.raises(ValueError, match="window_size"):
        sliding_windows(df, ["value"], 10, short="error")
    assert [r["series_id"] for r in short_series(df, 10).collect()] == ["s"]


def test_positions_and_head(series, limits):
    df = series({"s": range(30), "t": range(5)})
    assert values(row_position(df), "position") == [*range(30), *range(5)]
    assert values(first_rows(df, 20)) == [*range(20), *range(5)]


def test_profiles(series, limits):
    x = [1.0, 2, 3, 4, 5, 6, 7, 8, 9, 100, None]
    df = series({"s": x}, is_anomaly=[0] * 9 + [1, 0])
    o = overview(df).first()
    assert (o["n_rows"], o["span_days"], o["missing"], o["anomalies"]) == (11, 10, 1, 1)
    d = describe(df).first()
    s = pd.Series(x).describe()
    for name, key in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert d[name] == pytest.approx(s[key])
    assert [(r["column_name"], r["missing"]) for r in missing(df, ["value"]).collect()] == [("value", 1)]
    assert {r["is_anomaly"]: r["n_rows"] for r in class_balance(df, "is_anomaly").collect()} == {0: 10, 1: 1}
    b = box(df).first()
    assert (b["whisker_low"], b["whisker_high"], b["fliers"]) == (1, 9, 1)
    assert values(fliers(df)) == [100]
    h = histogram(df, bins=50).orderBy("bin").toPandas()
    want, edges = np.histogram(np.array(x[:-1], dtype=float), bins=50)
    assert h["n"].tolist() == want.tolist()
    np.testing.assert_allclose(h["bin_start"], edges[:-1])


def test_histogram_of_a_constant(series):
    h = histogram(series({"s": [3, 3, 3]}), bins=4).orderBy("bin").collect()
    assert [r["n"] for r in h] == [3, 0, 0, 0]


def test_unseen_series_stays(limits, series):
    for method in ("standard", "minmax", "robust"):
        model = Scaler(["value"], method).fit(series({"a": [1.0, 2.0, 4.0]}))
        out = model.transform(series({"a": [1.0, 2.0, 4.0], "b": [1.0, 2.0, 3.0]}))
        assert out.where("series_id = 'b' and value is null").count() == 3
        assert out.where("series_id = 'a' and value is not null").count() == 3


def test_all_numeric_columns_by_default(series):
    df = series({"a": [1.0, 2.0, 4.0]}, extra=[1, 5, 9])
    assert {"extra_lag_1", "value_lag_1"} <= set(add_features(df).columns)
    out, _ = normalize(df, method="minmax")
    assert [tuple(r) for r in out.orderBy("ts").select("extra", "value").collect()][-1] == (1.0, 1.0)
