"""The series the queries run on, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.sources.series import standardise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, series: str = "event_type") -> DataFrame:
    """Irregular series: one per event type, or per user."""
    return standardise(table(spark, sf_dir, "events"), "ts", "value", series=series, key="event_id")


EVENTS = "e AS (SELECT event_type AS s, ts, event_id AS k, value AS v FROM events)"
USERS = "e AS (SELECT CAST(user_id AS VARCHAR) AS s, ts, event_id AS k, value AS v FROM events)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per day and priority; days without orders are absent. Sums are exact decimals."""
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"))
        .agg(F.lit(0).cast("long").alias("row_key"), total.alias("value"))
    )


DAILY = """d AS (
    SELECT o_orderpriority AS s, o_orderdate AS ts, CAST(0 AS BIGINT) AS k,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v
    FROM orders GROUP BY 1, 2)"""


def daily_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms of the daily values, whose averages are no short decimals that two engines
    might round differently."""
    return daily(spark, sf_dir).withColumn("value", F.ln("value"))


DAILY_LOGS = DAILY.replace("d AS (", "r AS (", 1) + ",\n    d AS (SELECT s, ts, k, ln(v) AS v FROM r)"


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series on every day from their first to their last, null where absent."""
    present = daily(spark, sf_dir)
    span = present.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = span.select("series_id", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("ts"))
    return days.join(present, ["series_id", "ts"], "left").select(
        "series_id", "ts", F.lit(0).cast("long").alias("row_key"), "value"
    )


CALENDAR = DAILY + """,
    c AS (
    SELECT g.s, g.ts, CAST(0 AS BIGINT) AS k, d.v
    FROM (SELECT s, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM d GROUP BY s) g
    LEFT JOIN d ON d.s = g.s AND d.ts = g.ts)"""


CALENDAR_LOGS = CALENDAR.replace(DAILY, DAILY_LOGS)


def documents_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents under two simple detectors: unusually long, and unusually short, text."""
    rows = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    n = F.col("n_chars").cast("double")
    verdicts = F.array(
        F.struct(F.lit("long_text").alias("detector"), n.alias("score"), F.when(n > 2000, -1).otherwise(1).alias("label")),
        F.struct(F.lit("short_text").alias("detector"), (-n).alias("score"), F.when(n < 300, -1).otherwise(1).alias("label")),
    )
    return rows.select("doc_id", "quality", "toxic", F.explode(verdicts).alias("_v")).select(
        "doc_id", "quality", "toxic", "_v.*"
    )


DOCUMENTS = """x AS (
    SELECT l.doc_id, l.quality, l.toxic, 'long_text' AS detector, CAST(n_chars AS DOUBLE) AS score,
           CASE WHEN n_chars > 2000 THEN -1 ELSE 1 END AS label
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id
    UNION ALL
    SELECT l.doc_id, l.quality, l.toxic, 'short_text', CAST(-n_chars AS DOUBLE),
           CASE WHEN n_chars < 300 THEN -1 ELSE 1 END
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
