"""Describing series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.inputs import CALENDAR, EVENTS, calendar, events, table
from catalog.registry import query
from tideline.operators.profile import box, class_balance, describe, fliers, histogram, missing, overview
from tideline.plans.sketches import merged, near_quantiles, rank_error, sketches


@query(
    f"""WITH {CALENDAR} SELECT s AS series_id, count(*) AS n_rows, date_diff('day', min(ts), max(ts)) AS span_days,
        min(ts) AS first_ts, max(ts) AS last_ts, count(*) - count(v) AS missing,
        CAST(sum(CASE WHEN v > 400000 THEN 1 ELSE 0 END) AS BIGINT) AS anomalies,
        round(sum(CASE WHEN v > 400000 THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS anomaly_pct
    FROM c GROUP BY s"""
)
def profile_overview(spark: SparkSession, sf: str) -> DataFrame:
    labelled = calendar(spark, sf).withColumn("is_anomaly", F.when(F.col("value") > 400000, 1).otherwise(0))
    return overview(labelled).withColumn("anomaly_pct", F.round("anomaly_pct", 6))


@query(
    f"""WITH {EVENTS} SELECT s AS series_id, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
        min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
        round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max
    FROM e GROUP BY s"""
)
def profile_describe(spark: SparkSession, sf: str) -> DataFrame:
    return describe(events(spark, sf)).withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query(
    f"""WITH {CALENDAR}, t AS (SELECT count(*) AS n, count(*) - count(ts) AS a, count(*) - count(v) AS b FROM c)
    SELECT 'ts' AS column_name, a AS missing, round(a * 100.0 / n, 6) AS missing_pct FROM t
    UNION ALL SELECT 'value', b, round(b * 100.0 / n, 6) FROM t"""
)
def profile_missing(spark: SparkSession, sf: str) -> DataFrame:
    return missing(calendar(spark, sf), ["ts", "value"]).withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    """SELECT toxic, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS ratio
    FROM labels GROUP BY toxic"""
)
def class_balances(spark: SparkSession, sf: str) -> DataFrame:
    return class_balance(table(spark, sf, "labels"), "toxic").withColumn("ratio", F.round("ratio", 6))


@query(
    f"""WITH {EVENTS}, p AS (SELECT s, min(v) AS a, (max(v) - min(v)) / 50 AS w FROM e GROUP BY s),
    g AS (SELECT s, a, w, CAST(unnest(range(50)) AS INTEGER) AS bin FROM p),
    n AS (SELECT s, CAST(least(floor((v - a) / w), 49) AS INTEGER) AS bin, count(*) AS n FROM e JOIN p USING (s) GROUP BY 1, 2)
    SELECT g.s AS series_id, g.bin, round(a + w * g.bin, 6) AS bin_start, coalesce(n, 0) AS n
    FROM g LEFT JOIN n ON n.s = g.s AND n.bin = g.bin"""
)
def profile_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return histogram(events(spark, sf)).withColumn("bin_start", F.round("bin_start", 6))


QUARTILES = """q AS (SELECT s, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2,
    quantile_cont(v, 0.75) AS q3 FROM e GROUP BY s)"""


@query(
    f"""WITH {EVENTS}, {QUARTILES}
    SELECT s AS series_id, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
        min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
        max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
        count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS fliers
    FROM e JOIN q USING (s) GROUP BY s, q1, q2, q3"""
)
def profile_box(spark: SparkSession, sf: str) -> DataFrame:
    return box(events(spark, sf)).withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    f"""WITH {EVENTS}, {QUARTILES} SELECT s AS series_id, ts, k AS row_key, v AS value FROM e JOIN q USING (s)
    WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)"""
)
def profile_fliers(spark: SparkSession, sf: str) -> DataFrame:
    return fliers(events(spark, sf))


@query(
    f"""WITH {EVENTS} SELECT s AS series_id, count(v) AS n_values, count(DISTINCT CAST(ts AS DATE)) AS n_days,
        true AS in_order, 0 AS out_of_bound FROM e GROUP BY s"""
)
def quantile_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of days, merged per series: values whose exact ranks, counted over all rows, lie within
    twice the error that one sketch in a hundred exceeds."""
    rows = events(spark, sf)
    days = sketches(rows.withColumn("day", F.to_date("ts")), ["series_id", "day"], "value")
    whole = merged(days, ["series_id"])
    wanted = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q95": 0.95}
    found = near_quantiles(whole, ["series_id"], wanted)
    # One row per series.
    ranks = rows.join(F.broadcast(found), "series_id").groupBy("series_id").agg(
        F.count("value").alias("n_values"),
        F.countDistinct(F.to_date("ts")).alias("n_days"),
        F.bool_and((F.col("q05") <= F.col("q25")) & (F.col("q25") <= F.col("q50")) & (F.col("q50") <= F.col("q95"))).alias("in_order"),
        *[F.count_if(F.col("value") < F.col(c)).alias(f"{c}_below") for c in wanted],
        *[F.count_if(F.col("value") <= F.col(c)).alias(f"{c}_upto") for c in wanted],
    )
    bound = F.lit(2 * rank_error(400)) * F.col("n_values") + 1
    off = [
        F.when((F.col(f"{c}_below") > q * F.col("n_values") + bound) | (F.col(f"{c}_upto") < q * F.col("n_values") - bound), 1).otherwise(0)
        for c, q in wanted.items()
    ]
    return ranks.select("series_id", "n_values", "n_days", "in_order", sum(off[1:], off[0]).alias("out_of_bound"))
