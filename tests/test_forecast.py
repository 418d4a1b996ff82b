from __future__ import annotations

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators.forecast import Forecaster, _sparse_solve, with_actuals

COLUMNS = ["series_id", "ds", "yhat", "yhat_lower", "yhat_upper"]


@pytest.fixture
def noisy(series):
    return series({"s": np.random.default_rng(7).normal(50, 5, 100).tolist()})


@pytest.mark.parametrize("periods", [0, 5])
def test_length_and_interval(noisy, periods):
    out = Forecaster().fit(noisy).predict(noisy, periods)
    assert out.columns == COLUMNS
    rows = out.toPandas().sort_values("ds")
    assert len(rows) == 100 + periods
    assert (rows["yhat_lower"] <= rows["yhat"]).all() and (rows["yhat"] <= rows["yhat_upper"]).all()
    assert rows["ds"].is_unique and (rows["ds"].max() - rows["ds"].min()).days == 99 + periods


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_outliers_are_flagged(series, mode):
    x = np.random.default_rng(1).normal(50, 2, 100)
    x[50], x[75] = 500, -400
    out = Forecaster(seasonality_mode=mode).detect_anomalies(series({"s": x.tolist()})).orderBy("ts").toPandas()
    assert out["is_anomaly"][50] and out["is_anomaly"][75]
    assert out["is_anomaly"].sum() <= 10 and "value" in out


def test_trend_and_season_are_found(limits, series):
    t = np.arange(400)
    x = 100 + 0.05 * t + 5 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(0).normal(0, 0.5, 400)
    model = Forecaster(yearly_seasonality=False).fit(series({"s": x.tolist(), "u": (x * 3).tolist()}))
    got = model.predict(series({"s": x.tolist(), "u": (x * 3).tolist()}), 28).toPandas()
    for name, factor in (("s", 1), ("u", 3)):
        ahead = got[got["series_id"] == name].sort_values("ds").tail(28)["yhat"].to_numpy()
        t1 = np.arange(400, 428)
        want = factor * (100 + 0.05 * t1 + 5 * np.sin(2 * np.pi * t1 / 7))
        assert np.abs(ahead - want).max() < 1.5 * factor


def test_interval_grows_and_widens(noisy):
    rows = Forecaster(n_changepoints=5, changepoint_prior_scale=5.0).fit(noisy).predict(noisy, 60).orderBy("ds").toPandas()
    width = (rows["yhat_upper"] - rows["yhat_lower"]).to_numpy()
    assert width[-1] > width[100] > width[50] * 0.99
    narrow = Forecaster(interval_width=0.5).fit(noisy).predict(noisy, 0).orderBy("ds").toPandas()
    assert ((narrow["yhat_upper"] - narrow["yhat_lower"]) < width[0]).all()


def test_line_is_least_squares(limits, series):
    x = np.random.default_rng(3).normal(10, 2, 30) + np.arange(30)
    plain = Forecaster(n_changepoints=0, yearly_seasonality=False, weekly_seasonality=False)
    rows = plain.detect_anomalies(series({"s": x.tolist()})).orderBy("ts").toPandas()
    slope, start = np.polyfit(np.arange(30), x, 1)
    np.testing.assert_allclose(rows["yhat"], start + slope * np.arange(30), rtol=1e-9)
    sigma = np.sqrt(np.mean((x - rows["yhat"]) ** 2))
    np.testing.assert_allclose(rows["yhat_upper"] - rows["yhat"], 1.959963985 * sigma, rtol=1e-6)


def test_missing_values_are_not_anomalies(series):
    x = [*np.random.default_rng(0).normal(size=50).tolist(), None]
    out = Forecaster().detect_anomalies(series({"s": x})).orderBy("ts").collect()
    assert len(out) == 51 and out[-1]["is_anomaly"] is False and out[-1]["yhat"] is not None


def test_other_steps_and_actuals(noisy):
    out = Forecaster().fit(noisy).predict(noisy, 3, "1 hour")
    last = noisy.agg(F.max("ts")).first()[0]
    assert out.agg(F.max("ds")).first()[0] == last + dt.timedelta(hours=3)
    joined = with_actuals(out, noisy)
    assert joined.where("value IS NULL").count() == 3 and joined.count() == 103


@pytest.mark.parametrize("bad", [{"seasonality_mode": "other"}, {"interval_width": 1.5}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        Forecaster(**bad)


def test_needs_its_columns(noisy):
    with pytest.raises(ValueError):
        Forecaster().fit(noisy.drop("value"))


def test_series_without_values_stays(series):
    df = series({"a": [float(i % 6) for i in range(40)], "b": [None] * 40})
    out = Forecaster().detect_anomalies(df)
    assert out.count() == 80
    assert out.where("series_id = 'b' and yhat is null and not is_anomaly").count() == 40


def test_interval_at_high_levels(series):
    noise = np.random.default_rng(0).normal(0, 1, 300)
    noise[150] = 15
    plain = {"n_changepoints": 0, "yearly_seasonality": False, "weekly_seasonality": False}
    for mode in ("additive", "multiplicative"):
        out = Forecaster(seasonality_mode=mode, **plain).detect_anomalies(series({"s": (1e8 + noise).tolist()}))
        half = out.agg(F.avg((F.col("yhat_upper") - F.col("yhat_lower")) / 2)).first()[0]
        assert half == pytest.approx(1.96 * noise.std(), rel=0.05)
        assert out.where("row_key = 150 and is_anomaly").count() == 1


def test_settled_series_leave_the_rounds(spark, series):
    import math

    waves = [50.0 + 0.2 * i + 12 * math.sin(2 * math.pi * i / 7) * (1 + 0.01 * i) + (i * 7919 % 13) for i in range(90)]
    df = series({"flat": [5.0] * 90, "waves": waves})
    options = {"seasonality_mode": "multiplicative", "yearly_seasonality": False}
    full = Forecaster(**options).fit(df)
    assert full.unsettled().collect() == []
    with pytest.warns(UserWarning, match="1 series have not settled"):
        short = Forecaster(max_alternations=1, **options).fit(df)
    assert [r["series_id"] for r in short.unsettled().collect()] == ["waves"]
    # The series that settles is not touched by the one that goes on.
    rows = [m.params.where("series_id = 'flat'").collect() for m in (full, short)]
    assert rows[0] == rows[1]
    with pytest.warns(UserWarning, match="settled"):
        assert Forecaster(max_rounds=1).fit(df).unsettled().count() == 1


def test_simulated_paths(spark, series):
    bent = [float(i if i < 60 else 60 - 3 * (i - 60)) + (i * 7919 % 5) for i in range(100)]
    df = series({"line": [2.0 * i + (i * 31 % 7) for i in range(100)], "bent": bent})
    model = Forecaster(10.0, n_changepoints=10, yearly_seasonality=False, weekly_seasonality=False).fit(df)
    out = model.simulate(df, 30, draws=400).orderBy("series_id", "ds").toPandas()
    again = model.simulate(df.repartition(5), 30, draws=400).orderBy("series_id", "ds").toPandas()
    assert out.equals(again) and len(out) == 60
    assert ((out["yhat_lower"] <= out["yhat_median"]) & (out["yhat_median"] <= out["yhat_upper"])).all()
    width = (out["yhat_upper"] - out["yhat_lower"]).groupby(out["series_id"]).apply(list)
    # A slope that has changed may change again, by more than one that hardly did.
    grown = {k: w[-1] - w[0] for k, w in width.items()}
    assert width["bent"][-1] > 2 * width["bent"][0] and grown["bent"] > 2 * grown["line"]
    future = model.predict(df, 30).where("ds > timestamp_ntz'2024-04-09'").orderBy("series_id", "ds").toPandas()
    assert np.allclose(future["yhat"], out["yhat"])
    for wrong in ({"periods": 0}, {"periods": 3, "draws": 1}):
        with pytest.raises(ValueError):
            model.simulate(df, **wrong)


def test_sparse_changes_are_the_least(limits, series):
    draw = np.random.default_rng(5)
    t = np.arange(300)
    bent = 20 + 0.1 * t + 0.9 * np.maximum(t - 299 * 0.4, 0) + np.sin(2 * np.pi * t / 7) + draw.normal(0, 1, 300)
    flat = 5 + draw.normal(0, 1, 300)
    rows = series({"bent": bent.tolist(), "flat": flat.tolist(), "line": (3.0 * t).tolist(), "same": [4.0] * 300})
    spec = Forecaster(changepoint_prior="laplace", n_changepoints=15, yearly_seasonality=False)
    model = spec.fit(rows)
    assert model.unsettled().count() == 0
    got = model.slope_changes(rows).toPandas()
    assert got.groupby("series_id").size().to_dict() == {"bent": 15, "flat": 15, "line": 15, "same": 15}
    told = got[got["series_id"].isin(["bent", "flat"])]
    on = told["per_day"] != 0
    assert (abs(told["gradient"][on] - np.sign(told["per_day"][on])) < 1e-4).all()
    assert (abs(told["gradient"][~on]) < 1 + 1e-4).all() and 0 < on.sum() < 15
    assert (got["per_day"][got["series_id"] == "flat"] == 0).sum() >= 13
    top = got[got["series_id"] == "bent"].sort_values("per_day").iloc[-1]
    assert abs((top["changepoint"] - pd.Timestamp("2024-01-01")).total_seconds() / 86400 - 299 * 0.4) < 20
    assert abs(got["per_day"][got["series_id"] == "bent"].sum() - 0.9) < 0.1
    # Normal priors: the gradient is the change over its prior's width.
    normal = Forecaster(n_changepoints=15, yearly_seasonality=False).fit(rows)
    ridge = normal.slope_changes(rows).toPandas()
    assert (ridge["per_day"][ridge["series_id"] == "bent"] != 0).all()


@pytest.mark.parametrize("seed", range(6))
def test_sparse_solution_against_all_sign_patterns(seed):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(30, 7)) @ (np.eye(7) + 0.5)
    if seed == 0:
        x[:, 3] = x[:, 4]
    y = x @ np.array([1.0, 2, 0, 0, 3, 0, -1]) + draw.normal(size=30)
    sparse = np.arange(7) >= 2
    gram, target = x.T @ x, x.T @ y
    ridge, penalty = np.where(sparse, 0.0, 0.3), np.full(7, 15.0)

    def cost(b):
        return b @ gram @ b / 2 - target @ b + (ridge * b * b).sum() / 2 + (penalty * np.abs(b))[sparse].sum()

    beta, reached = _sparse_solve(gram, target, ridge, sparse, penalty, np.zeros(7), 1000)
    best = np.inf
    for signs in itertools.product([-1, 0, 1], repeat=5):
        s = np.concatenate([[2, 2], signs])
        on = s != 0
        b = np.zeros(7)
        b[on] = np.linalg.lstsq((gram + np.diag(ridge))[np.ix_(on, on)], (target - np.where(sparse, penalty * s, 0))[on], rcond=None)[0]
        best = min(best, cost(b))
    assert reached and cost(beta) <= best + 1e-6


def test_sparse_multiplicative(series):
    t = np.arange(200)
    x = (50 + np.maximum(t - 100, 0)) * (1 + 0.2 * np.sin(2 * np.pi * t / 7)) + np.random.default_rng(2).normal(0, 0.5, 200)
    rows = series({"s": x.tolist()})
    model = Forecaster(changepoint_prior="laplace", seasonality_mode="multiplicative", yearly_seasonality=False).fit(rows)
    got = model.slope_changes(rows).toPandas()
    on = got["per_day"] != 0
    assert model.unsettled().count() == 0 and (abs(got["gradient"][on] - np.sign(got["per_day"][on])) < 0.1).all()


def test_prior_is_known():
    with pytest.raises(ValueError, match="laplace"):
        Forecaster(changepoint_prior="cauchy")
