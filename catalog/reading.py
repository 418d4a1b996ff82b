"""Sources, sinks and projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.inputs import DAILY, EVENTS, daily, events, table
from catalog.registry import query
from tideline.operators.rolling import first_rows, row_position
from tideline.plans import scratch_path
from tideline.sources.series import (
    detect_analysis_column,
    detect_date_column,
    detect_value_column,
    normalise_ticker,
    read_csv,
    select_ohlcv,
    standardise,
    validate,
)
from tideline.sources.synthetic import clean_value, with_spikes
from tideline.sources.tables import fetch_series, result_rows, series_rows


@query(
    """SELECT o_orderpriority AS series_id, o_orderdate AS ts, o_orderkey AS row_key, o_totalprice AS value
    FROM orders"""
)
def series_standardise(spark: SparkSession, sf: str) -> DataFrame:
    out = standardise(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", series="o_orderpriority", key="o_orderkey")
    return out.withColumnRenamed("o_totalprice", "value")


@query(
    """SELECT 'series' AS series_id, o_orderdate AS ts, o_orderkey AS row_key,
        CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice FROM orders"""
)
def series_all_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return standardise(table(spark, sf, "orders"), "o_orderdate", key="o_orderkey")


@query(
    """SELECT l_returnflag AS series_id, l_shipdate AS ts,
        arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS "Close"
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
      AND l_returnflag IN ('A', 'R')
    GROUP BY 1, 2"""
)
def series_ohlcv(spark: SparkSession, sf: str) -> DataFrame:
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    prices = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").alias("date"))
        .agg(
            F.min_by("l_extendedprice", place).alias("Open"),
            F.max("l_extendedprice").alias("High"),
            F.min("l_extendedprice").alias("Low"),
            F.max_by("l_extendedprice", place).alias("Close"),
            F.sum("l_quantity").alias("Volume"),
        )
    )
    out = select_ohlcv(prices, ["A", "R"], dt.datetime(1996, 1, 1), dt.datetime(1998, 1, 1))
    return out.drop("row_key")


@query(
    """SELECT 'ds' AS date_column, 'y' AS value_column, 'y' AS analysis_column, o_orderpriority AS series_id,
        min(o_orderdate) AS first_ts, max(o_totalprice) AS highest, count(*) AS n_rows
    FROM orders GROUP BY o_orderpriority"""
)
def series_autodetect(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select(
        "o_orderpriority", F.col("o_orderdate").alias("ds"), F.col("o_totalprice").alias("y"), "o_orderkey"
    )
    date, value = detect_date_column(raw), detect_value_column(raw)
    series = standardise(raw, date, value, series="o_orderpriority", key="o_orderkey")
    chosen = detect_analysis_column(series)
    found = [F.lit(date).alias("date_column"), F.lit(value).alias("value_column"), F.lit(chosen).alias("analysis_column")]
    return series.groupBy(*found, "series_id").agg(
        F.min("ts").alias("first_ts"), F.max(chosen).alias("highest"), F.count(F.lit(1)).alias("n_rows")
    )


@query(
    """WITH t AS (SELECT upper(trim(p_brand)) AS t FROM part UNION ALL SELECT upper(trim(' ' || p_type || ' ')) FROM part)
    SELECT CASE WHEN regexp_full_match(t, '[A-Z0-9.\\-^=]{1,20}') THEN t END AS ticker, count(*) AS n
    FROM t GROUP BY 1"""
)
def ticker_check(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    names = part.select(F.col("p_brand").alias("t")).union(part.select(F.concat(F.lit(" "), "p_type", F.lit(" "))))
    return names.groupBy(normalise_ticker("t").alias("ticker")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH t AS (SELECT count(*) AS n,
        count(*) FILTER (WHERE url IS NULL) AS u, count(*) FILTER (WHERE page_id IS NULL) AS p,
        count(*) FILTER (WHERE url IS NOT NULL AND TRY_CAST(url AS DOUBLE) IS NULL) AS un,
        count(*) FILTER (WHERE page_id IS NOT NULL AND TRY_CAST(page_id AS DOUBLE) IS NULL) AS pn FROM pages)
    SELECT 'rows' AS rule, n AS "rows" FROM t UNION ALL SELECT 'url missing', u FROM t
    UNION ALL SELECT 'page_id missing', p FROM t UNION ALL SELECT 'url not numeric', un FROM t
    UNION ALL SELECT 'page_id not numeric', pn FROM t"""
)
def validation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return validate(table(spark, sf, "pages"), ["url", "page_id"], ["url", "page_id"])


@query("SELECT event_type AS series_id, ts, event_id AS row_key, value, CAST(user_id AS DOUBLE) AS user_id FROM events")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    rows = table(spark, sf, "events").select(F.col("ts").alias("date"), "value", "event_id", "event_type", "user_id")
    rows.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    out = read_csv(spark, path, series="event_type", key="event_id", extra={"event_id": "bigint"})
    return out.withColumnRenamed("date", "ts")


@query(
    """SELECT event_type AS series_id, ts, event_id AS row_key, value, CASE WHEN value > 200 THEN 1 ELSE 0 END AS is_anomaly
    FROM events"""
)
def csv_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """A sample file with its truth beside the values, as whole numbers."""
    path = scratch_path(spark, "csv")
    label = F.when(F.col("value") > 200, 1).otherwise(0).alias("is_anomaly")
    rows = table(spark, sf, "events").select(F.col("ts").alias("date"), "value", label, "event_id", "event_type")
    rows.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return read_csv(spark, path, series="event_type", key="event_id", extra={"event_id": "bigint", "is_anomaly": "int"})


@query(
    """SELECT event_type AS series_id, ts, event_id AS row_key, value FROM events
    WHERE event_type IN ('click', 'view')"""
)
def series_table_fetch(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("name"), "ts", "value"
    )
    return fetch_series(stored, ["click", "view"])


@query("SELECT event_type AS name, ts, value FROM events")
def series_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    return series_rows(events(spark, sf))


def _long_values(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "series_id", "ts", "row_key", F.lit("cut").alias("detector"), F.col("value").alias("score"),
        F.when(F.col("value") > 200, -1).otherwise(1).alias("label"),
    )


@query(
    f"""WITH {EVENTS} SELECT s AS series_name, 'cut' AS method, count(*) AS points,
        CAST(sum(CASE WHEN v > 200 THEN 1 ELSE 0 END) AS BIGINT) AS anomalies, max(v) AS max_score
    FROM e GROUP BY s"""
)
def results_json(spark: SparkSession, sf: str) -> DataFrame:
    stored = result_rows(_long_values(spark, sf), points=False)
    body = F.from_json("results", "points long, anomalies long, max_score double").alias("b")
    return stored.select("series_name", "method", body).select("series_name", "method", "b.*")


@query(
    f"""WITH {EVENTS} SELECT s AS series_name, 'cut' AS method, CAST(ceil(count(*) / 10000.0) AS BIGINT) AS documents,
        count(*) AS points, CAST(sum(k) AS BIGINT) AS key_sum, round(sum(v), 2) AS score_sum
    FROM e GROUP BY s"""
)
def results_json_points(spark: SparkSession, sf: str) -> DataFrame:
    stored = result_rows(_long_values(spark, sf))
    body = F.from_json("results", "points array<struct<row_key:bigint,score:double,label:int>>")["points"]
    rows = stored.select("series_name", "method", F.posexplode(body).alias("i", "p"))
    return rows.groupBy("series_name", "method").agg(
        F.count_if(F.col("i") == 0).alias("documents"),
        F.count(F.lit(1)).alias("points"),
        F.sum("p.row_key").alias("key_sum"),
        F.round(F.sum("p.score"), 2).alias("score_sum"),
    )


def _days(spark: SparkSession, sf: str) -> DataFrame:
    return daily(spark, sf).select("series_id", F.date_diff("ts", F.lit("1995-01-01").cast("date")).cast("long").alias("day"))


@query(
    f"""WITH {DAILY} SELECT s AS series_id, date_diff('day', TIMESTAMP '1995-01-01', ts) AS day,
        round(100.0 + date_diff('day', TIMESTAMP '1995-01-01', ts) * 0.05
          + 5.0 * sin(2 * pi() * date_diff('day', TIMESTAMP '1995-01-01', ts) / 7)
          + 10.0 * sin(2 * pi() * date_diff('day', TIMESTAMP '1995-01-01', ts) / 365), 6) AS value
    FROM d"""
)
def synthetic_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _days(spark, sf).withColumn("value", F.round(clean_value(F.col("day")), 6))


@query(
    f"""WITH {DAILY} SELECT s AS series_id, count(*) AS n_days,
        CAST(greatest(1, floor(count(*) * 0.02)) AS BIGINT) AS spikes, true AS spikes_stand_out
    FROM d GROUP BY s"""
)
def synthetic_spiked(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_spikes(_days(spark, sf), noise_level=2.0)
    off = F.abs(F.col("value") - clean_value(F.col("day")))
    return rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum(F.col("is_anomaly").cast("long")).alias("spikes"),
        (F.avg(F.when(F.col("is_anomaly") == 1, off)) > 3 * F.avg(F.when(F.col("is_anomaly") == 0, off))).alias("spikes_stand_out"),
    )


@query(
    f"""WITH {EVENTS} SELECT s AS series_id, ts, k AS row_key, v AS value,
        row_number() OVER (PARTITION BY s ORDER BY ts, k) - 1 AS position FROM e"""
)
def row_positions(spark: SparkSession, sf: str) -> DataFrame:
    return row_position(events(spark, sf))


@query(
    f"""WITH {EVENTS} SELECT s AS series_id, ts, k AS row_key, v AS value FROM e
    QUALIFY row_number() OVER (PARTITION BY s ORDER BY ts, k) <= 20"""
)
def series_head(spark: SparkSession, sf: str) -> DataFrame:
    return first_rows(events(spark, sf), 20)
