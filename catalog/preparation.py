"""Missing values, scaling, rolling features and windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.inputs import CALENDAR_LOGS, DAILY_LOGS, EVENTS, USERS, calendar, daily_logs, events, table
from catalog.registry import query
from tideline.operators.missing import handle_missing
from tideline.operators.rolling import add_features, rolling_band, short_series, sliding_windows
from tideline.operators.scaling import Scaler, normalize
from tideline.operators.timeframes import rolling_time


def _filled(strategy: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        logs = calendar(spark, sf).withColumn("value", F.ln("value"))
        out = handle_missing(logs, ["value"], strategy)
        return out.select("series_id", "ts", F.round("value", 6).alias("value"))

    return run


# The neighbouring present values of every day, found by joins on running counts.
_AROUND = f"""WITH {CALENDAR_LOGS},
    f AS (SELECT *, count(v) OVER (PARTITION BY s ORDER BY ts) AS up,
        count(v) OVER (PARTITION BY s ORDER BY ts DESC) AS down FROM c),
    p AS (SELECT s, up, ts AS pt, v AS pv FROM f WHERE v IS NOT NULL),
    n AS (SELECT s, down, ts AS nt, v AS nv FROM f WHERE v IS NOT NULL),
    a AS (SELECT f.s, f.ts, f.v, pt, pv, nt, nv FROM f
        LEFT JOIN p ON p.s = f.s AND p.up = f.up LEFT JOIN n ON n.s = f.s AND n.down = f.down)"""


@query(
    _AROUND
    + """SELECT s AS series_id, ts, round(coalesce(v,
        pv + (nv - pv) * ((epoch_us(ts) - epoch_us(pt)) / nullif(epoch_us(nt) - epoch_us(pt), 0)), pv, nv), 6) AS value
    FROM a"""
)
def fill_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    return _filled("interpolate")(spark, sf)


@query(_AROUND + "SELECT s AS series_id, ts, round(pv, 6) AS value FROM a")
def fill_ffill(spark: SparkSession, sf: str) -> DataFrame:
    return _filled("ffill")(spark, sf)


@query(_AROUND + "SELECT s AS series_id, ts, round(nv, 6) AS value FROM a")
def fill_bfill(spark: SparkSession, sf: str) -> DataFrame:
    return _filled("bfill")(spark, sf)


@query(f"WITH {CALENDAR_LOGS} SELECT s AS series_id, ts, round(v, 6) AS value FROM c WHERE v IS NOT NULL")
def fill_drop(spark: SparkSession, sf: str) -> DataFrame:
    return _filled("drop")(spark, sf)


def _scaled(method: str, series: str = "event_type"):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out, _ = normalize(events(spark, sf, series), ["value"], method)
        return out.withColumn("value", F.round("value", 6))

    return run


def _scaled_sql(series: str, centre: str, spread: str) -> str:
    return f"""WITH {series}, p AS (SELECT s, {centre} AS a, {spread} AS b FROM e GROUP BY s)
    SELECT s AS series_id, ts, k AS row_key, round((v - a) / CASE WHEN b = 0 THEN 1 ELSE b END, 6) AS value
    FROM e JOIN p USING (s)"""


@query(_scaled_sql(EVENTS, "avg(v)", "stddev_pop(v)"))
def scale_standard(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled("standard")(spark, sf)


@query(_scaled_sql(EVENTS, "min(v)", "max(v) - min(v)"))
def scale_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled("minmax")(spark, sf)


@query(_scaled_sql(EVENTS, "median(v)", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)"))
def scale_robust(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled("robust")(spark, sf)


@query(_scaled_sql(USERS, "avg(v)", "stddev_pop(v)"))
def scale_standard_many(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled("standard", "user_id")(spark, sf)


@query(
    f"""WITH {EVENTS}, p AS (SELECT s, avg(v) AS c, stddev_pop(v) AS w FROM e WHERE s IN ('click', 'view') GROUP BY s)
    SELECT e.s AS series_id, ts, k AS row_key, round((v - c) / w, 6) AS value FROM e LEFT JOIN p USING (s)"""
)
def scale_unseen_series(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of series that were not fitted stay, without a value."""
    rows = events(spark, sf)
    model = Scaler(["value"]).fit(rows.where(F.col("series_id").isin("click", "view")))
    return model.transform(rows).withColumn("value", F.round("value", 6))


@query(
    """SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, c_nationkey FROM customer"""
)
def scale_inverse(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    model = Scaler(["c_acctbal"], "robust", by=["c_nationkey"]).fit(rows)
    back = model.inverse_transform(model.transform(rows))
    return back.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query(
    f"""WITH {DAILY_LOGS} SELECT s AS series_id, ts, round(v, 6) AS value,
        round(avg(v) OVER w7, 6) AS value_rolling_mean_7, round(stddev_samp(v) OVER w7, 6) AS value_rolling_std_7,
        round(avg(v) OVER w30, 6) AS value_rolling_mean_30, round(stddev_samp(v) OVER w30, 6) AS value_rolling_std_30,
        round(lag(v, 1) OVER w, 6) AS value_lag_1, round(lag(v, 7) OVER w, 6) AS value_lag_7,
        CAST(isodow(ts) - 1 AS TINYINT) AS day_of_week, CAST(month(ts) AS TINYINT) AS month
    FROM d WINDOW w AS (PARTITION BY s ORDER BY ts),
        w7 AS (PARTITION BY s ORDER BY ts ROWS 6 PRECEDING), w30 AS (PARTITION BY s ORDER BY ts ROWS 29 PRECEDING)"""
)
def features_full(spark: SparkSession, sf: str) -> DataFrame:
    out = add_features(daily_logs(spark, sf), ["value"]).drop("row_key")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("value")})


BAND = """b AS (SELECT *, m - 2 * sd AS lo, m + 2 * sd AS hi FROM (
    SELECT s, ts, k, v, CASE WHEN count(v) OVER w = 30 THEN avg(v) OVER w END AS m,
        CASE WHEN count(v) OVER w = 30 THEN stddev_samp(v) OVER w END AS sd
    FROM {} WINDOW w AS (PARTITION BY s ORDER BY ts, k ROWS 29 PRECEDING)))"""


@query(
    f"""WITH {DAILY_LOGS}, {BAND.format('d')} SELECT s AS series_id, ts, round(v, 6) AS value,
        round(m, 6) AS rolling_mean, round(sd, 6) AS rolling_std, round(lo, 6) AS band_lower,
        round(hi, 6) AS band_upper, coalesce(v < lo OR v > hi, false) AS outside_band
    FROM b"""
)
def rolling_bands(spark: SparkSession, sf: str) -> DataFrame:
    out = rolling_band(daily_logs(spark, sf)).drop("row_key")
    numbers = ("value", "rolling_mean", "rolling_std", "band_lower", "band_upper")
    return out.withColumns({c: F.round(c, 6) for c in numbers})


def _time_frames(series: str, span: str) -> str:
    return f"""WITH {series} SELECT s AS series_id, ts, k AS row_key, v AS value, count(v) OVER w AS rolling_n,
        round(avg(v) OVER w, 6) AS rolling_mean, round(stddev_samp(v) OVER w, 6) AS rolling_std,
        min(v) OVER w AS rolling_min, max(v) OVER w AS rolling_max
    FROM e WINDOW w AS (PARTITION BY s ORDER BY ts RANGE BETWEEN INTERVAL {span} PRECEDING AND CURRENT ROW)"""


def _rounded_frames(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("rolling_mean", "rolling_std")})


@query(_time_frames(EVENTS, "6 HOUR"))
def rolling_time_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular rows, framed by hours instead of a number of rows."""
    return _rounded_frames(rolling_time(events(spark, sf), span=dt.timedelta(hours=6)))


@query(_time_frames(USERS, "3 DAY"))
def rolling_time_frames_many(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_frames(rolling_time(events(spark, sf, "user_id"), span=dt.timedelta(days=3)))


@query(
    f"""WITH {EVENTS} SELECT s AS series_id, ts, k AS row_key, round(sum(v) OVER w, 4) AS total,
        min(v) OVER w AS lowest, max(v) OVER w AS highest, first_value(v) OVER w AS first_step, v AS last_step
    FROM e WINDOW w AS (PARTITION BY s ORDER BY ts, k ROWS 29 PRECEDING)
    QUALIFY row_number() OVER (PARTITION BY s ORDER BY ts, k) >= 30"""
)
def windows_summary(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.flatten("window")
    return sliding_windows(events(spark, sf), ["value"], 30).select(
        "series_id", "ts", "row_key",
        F.round(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
        F.array_min(steps).alias("lowest"),
        F.array_max(steps).alias("highest"),
        F.element_at(steps, 1).alias("first_step"),
        F.element_at(steps, -1).alias("last_step"),
    )


@query(f"WITH {USERS} SELECT s AS series_id, count(*) AS n_rows FROM e GROUP BY s HAVING count(*) < 60")
def windows_skipped(spark: SparkSession, sf: str) -> DataFrame:
    return short_series(events(spark, sf, "user_id"), 60)
