"""Forecasts and interval-based flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from catalog.inputs import CALENDAR, DAILY, calendar, daily
from catalog.registry import query
from tideline.operators.forecast import Forecaster, with_actuals

_PLAIN = {"n_changepoints": 0, "yearly_seasonality": False, "weekly_seasonality": False}

# A straight line per series; the interval is 1.96 residual deviations either way.
_LINE = """r AS (SELECT s, epoch_us(min(ts)) AS t0, regr_slope(v, epoch_us(ts) / 1e6 / 86400) AS b,
        avg(v) AS my, avg(epoch_us(ts) / 1e6 / 86400) AS mx, max(ts) AS last FROM {0} WHERE v IS NOT NULL GROUP BY s),
    g AS (SELECT {0}.s, sqrt(avg(pow(v - my - b * (epoch_us(ts) / 1e6 / 86400 - mx), 2))) AS sd FROM {0} JOIN r USING (s)
        WHERE v IS NOT NULL GROUP BY {0}.s)"""
_YHAT = "my + b * (epoch_us(ts) / 1e6 / 86400 - mx)"
_Z = 1.959963984540054


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in ("yhat", "yhat_lower", "yhat_upper")})


@query(
    f"""WITH {DAILY}, {_LINE.format('d')},
    a AS (SELECT s, ts FROM d UNION ALL SELECT s, last + i * INTERVAL 1 DAY FROM r, (SELECT unnest(range(1, 15)) AS i))
    SELECT s AS series_id, ts AS ds, round({_YHAT}, 2) AS yhat, round({_YHAT} - {_Z} * sd, 2) AS yhat_lower,
        round({_YHAT} + {_Z} * sd, 2) AS yhat_upper
    FROM a JOIN r USING (s) JOIN g USING (s)"""
)
def forecast_linear(spark: SparkSession, sf: str) -> DataFrame:
    rows = daily(spark, sf)
    return _rounded(Forecaster(**_PLAIN).fit(rows).predict(rows, 14))


@query(
    f"""WITH {CALENDAR}, {_LINE.format('c')}
    SELECT c.s AS series_id, ts, v AS value, round({_YHAT}, 2) AS yhat, round({_YHAT} - {_Z} * sd, 2) AS yhat_lower,
        round({_YHAT} + {_Z} * sd, 2) AS yhat_upper,
        coalesce(v < {_YHAT} - {_Z} * sd OR v > {_YHAT} + {_Z} * sd, false) AS is_anomaly
    FROM c JOIN r USING (s) JOIN g USING (s)"""
)
def forecast_linear_flags(spark: SparkSession, sf: str) -> DataFrame:
    out = Forecaster(**_PLAIN).detect_anomalies(calendar(spark, sf))
    return _rounded(out).drop("row_key")


@query(
    f"""WITH {DAILY}, {_LINE.format('d')},
    a AS (SELECT s, ts FROM d UNION ALL SELECT s, last + i * INTERVAL 1 DAY FROM r, (SELECT unnest(range(1, 15)) AS i))
    SELECT a.s AS series_id, a.ts AS ds, round(my + b * (epoch_us(a.ts) / 1e6 / 86400 - mx), 2) AS yhat, d.v AS value
    FROM a JOIN r USING (s) LEFT JOIN d ON d.s = a.s AND d.ts = a.ts"""
)
def forecast_actuals(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast rows beside what was observed; future rows have no value."""
    rows = daily(spark, sf)
    forecast = _rounded(Forecaster(**_PLAIN).fit(rows).predict(rows, 14))
    return with_actuals(forecast, rows).select("series_id", "ds", "yhat", "value")


_GAP = CALENDAR.replace("LEFT JOIN d ON", "LEFT JOIN d ON g.s <> '1-URGENT' AND")


@query(
    f"""WITH {_GAP}, {_LINE.format('c')}
    SELECT c.s AS series_id, ts, v AS value, round({_YHAT}, 2) AS yhat, round({_YHAT} - {_Z} * sd, 2) AS yhat_lower,
        round({_YHAT} + {_Z} * sd, 2) AS yhat_upper,
        coalesce(v < {_YHAT} - {_Z} * sd OR v > {_YHAT} + {_Z} * sd, false) AS is_anomaly
    FROM c LEFT JOIN r USING (s) LEFT JOIN g USING (s)"""
)
def forecast_null_series(spark: SparkSession, sf: str) -> DataFrame:
    """A series without any value keeps its rows and has no flags."""
    known = F.when(F.col("series_id") != "1-URGENT", F.col("value"))
    out = Forecaster(**_PLAIN).detect_anomalies(calendar(spark, sf).withColumn("value", known))
    return _rounded(out).drop("row_key")


# The full model has no counterpart in SQL, which states what must hold of its rows instead.


@query()
def forecast_full(spark: SparkSession, sf: str) -> DataFrame:
    rows = daily(spark, sf)
    return with_actuals(_rounded(Forecaster().fit(rows).predict(rows, 30)), rows)


@query()
def forecast_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(Forecaster().detect_anomalies(daily(spark, sf)))


@query()
def forecast_multiplicative(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(Forecaster(seasonality_mode="multiplicative").detect_anomalies(daily(spark, sf)))


@query(
    f"""WITH {DAILY} SELECT s AS series_id, count(*) + 30 AS n_rows, count(*) AS observed, 0 AS outside_interval,
        true AS closer_than_mean FROM d GROUP BY s"""
)
def forecast_full_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = daily(spark, sf)
    forecast = with_actuals(Forecaster().fit(rows).predict(rows, 30), rows)
    rest = F.col("value") - F.col("yhat")
    return forecast.groupBy("series_id").agg(
        F.count("yhat").alias("n_rows"),
        F.count("value").alias("observed"),
        F.count_if((F.col("yhat") < F.col("yhat_lower")) | (F.col("yhat") > F.col("yhat_upper"))).cast("int").alias("outside_interval"),
        (F.sqrt(F.avg(rest * rest)) <= F.stddev_pop("value")).alias("closer_than_mean"),
    )


_PLANTED_SQL = f"""WITH {DAILY} SELECT s AS series_id, count(*) AS n_rows, 0 AS outside_interval,
        count(*) FILTER (WHERE dayofyear(ts) = 100) AS planted, count(*) FILTER (WHERE dayofyear(ts) = 100) AS planted_flagged
    FROM d GROUP BY s"""


def _planted_flags(spark: SparkSession, sf: str, forecaster: Forecaster) -> DataFrame:
    """Once a year a value is far above all others."""
    planted = F.dayofyear("ts") == 100
    rows = daily(spark, sf).withColumn("value", F.when(planted, F.lit(1e9)).otherwise(F.col("value")))
    out = forecaster.detect_anomalies(rows)
    return out.groupBy("series_id").agg(
        F.count("yhat").alias("n_rows"),
        F.count_if((F.col("yhat") < F.col("yhat_lower")) | (F.col("yhat") > F.col("yhat_upper"))).cast("int").alias("outside_interval"),
        F.count_if(planted).alias("planted"),
        F.count_if(planted & F.col("is_anomaly")).alias("planted_flagged"),
    )


@query(_PLANTED_SQL)
def forecast_flags_facts(spark: SparkSession, sf: str) -> DataFrame:
    return _planted_flags(spark, sf, Forecaster(yearly_seasonality=False))


@query(_PLANTED_SQL)
def forecast_multiplicative_facts(spark: SparkSession, sf: str) -> DataFrame:
    return _planted_flags(spark, sf, Forecaster(seasonality_mode="multiplicative", yearly_seasonality=False))


@query(
    f"""WITH {DAILY}, m AS (SELECT max(ts) AS last FROM d)
    SELECT s AS series_id, 40 AS n_rows, 0 AS out_of_order, true AS wider FROM d, m
    WHERE ts <= last - INTERVAL 40 DAY GROUP BY s"""
)
def forecast_simulated(spark: SparkSession, sf: str) -> DataFrame:
    """Simulated intervals of the last 40 days from the days before: in order and wider with time."""
    rows = daily(spark, sf)
    last = rows.agg(F.max("ts").alias("last"))
    past = rows.join(F.broadcast(last), F.lit(True)).where(F.col("ts") <= F.col("last") - F.expr("interval 40 days")).drop("last")
    ahead = Forecaster(yearly_seasonality=False).fit(past).simulate(past, 40, draws=500)
    width = F.col("yhat_upper") - F.col("yhat_lower")
    seen = ahead.withColumn("_i", F.row_number().over(Window.partitionBy("series_id").orderBy("ds")))
    return seen.groupBy("series_id").agg(
        F.count("yhat").cast("int").alias("n_rows"),
        F.count_if((F.col("yhat_lower") > F.col("yhat_median")) | (F.col("yhat_median") > F.col("yhat_upper"))).cast("int").alias("out_of_order"),
        (F.avg(F.when(F.col("_i") > 20, width)) >= 0.98 * F.avg(F.when(F.col("_i") <= 20, width))).alias("wider"),
    )


@query()
def forecast_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """The full model with sparse slope changes."""
    rows = daily(spark, sf)
    return with_actuals(_rounded(Forecaster(changepoint_prior="laplace").fit(rows).predict(rows, 30)), rows)


@query(
    f"""WITH {DAILY} SELECT s AS series_id, 24 AS n_changepoints, 0 AS against_conditions, true AS planted_found,
        true AS mostly_zero FROM d GROUP BY s"""
)
def forecast_sparse_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Daily values and, from half of the history on, a rise. Of the fitted slope changes must hold what
    makes them the best there are: gradient 1 or −1 where the slope changes, at most 1 elsewhere. The
    greatest change is beside the planted one, and over half are zero."""
    rows = daily(spark, sf)
    edge = rows.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.stddev_pop("value").alias("sd"))
    along = (F.unix_timestamp("ts") - F.unix_timestamp("a")) / (F.unix_timestamp("b") - F.unix_timestamp("a"))
    bent = rows.join(F.broadcast(edge), "series_id").withColumn("_along", along)
    bent = bent.withColumn("value", F.col("value") + 100 * F.col("sd") * F.greatest(F.col("_along") - 0.5, F.lit(0.0)))
    bent = bent.select(*rows.columns)
    model = Forecaster(changepoint_prior="laplace", n_changepoints=24, yearly_seasonality=False).fit(bent)
    changes = model.slope_changes(bent).join(F.broadcast(edge), "series_id")
    place = (F.unix_timestamp("changepoint") - F.unix_timestamp("a")) / (F.unix_timestamp("b") - F.unix_timestamp("a"))
    off = F.when(F.col("per_day") == 0, F.abs("gradient") - 1).otherwise(F.abs(F.col("gradient") - F.signum("per_day")))
    return changes.groupBy("series_id").agg(
        F.count("gradient").cast("int").alias("n_changepoints"),
        F.count_if(off > 1e-3).cast("int").alias("against_conditions"),
        (F.abs(F.max_by(place, F.abs("per_day")) - 0.5) <= 0.04).alias("planted_found"),
        (F.count_if(F.col("per_day") == 0) > 12).alias("mostly_zero"),
    )
