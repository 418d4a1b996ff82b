"""Describing series: overview, statistics, missing values, balance, histogram, box plot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tideline.functions.labels import outside
from tideline.plans import attach, freeze, quantiles
from tideline.sources.series import SERIES, TRUTH, TS


def overview(df: DataFrame, value: str = "value", truth: str | None = None, by: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """Rows, whole days spanned, missing values, labelled anomalies and their share in percent."""
    truth = truth or (TRUTH if TRUTH in df.columns else None)
    labelled = []
    if truth:
        flagged = F.sum(F.col(truth).cast("long"))
        labelled = [flagged.alias("anomalies"), (flagged / F.count(F.lit(1)) * 100).alias("anomaly_pct")]
    span = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.floor(span / F.lit(86_400_000_000)).alias("span_days"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count_if(F.col(value).isNull()).alias("missing"),
        *labelled,
    )


def describe(df: DataFrame, value: str = "value", by: Sequence[str] = (SERIES,)) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum."""
    by = list(by)
    basic = df.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    q = quantiles(df, by, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    joined = attach(basic, q, by, how="left")
    return joined.select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column, and their share in percent."""
    totals = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = totals.unpivot(["_n"], list(columns), "column_name", "missing")
    return long.select("column_name", "missing", (F.col("missing") * 100 / F.col("_n")).alias("missing_pct"))


def class_balance(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class and their share; however many classes there are, no task holds all of them."""
    by = list(by)
    counts = freeze(df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n_rows")), "classes")
    totals = counts.groupBy(*by).agg(F.sum("n_rows").alias("_total"))
    return attach(counts, totals, by).withColumn("ratio", F.col("n_rows") / F.col("_total")).drop("_total")


def histogram(df: DataFrame, value: str = "value", bins: int = 50, by: Sequence[str] = (SERIES,)) -> DataFrame:
    """Equal bins between the extremes of each series, the last one closed; empty bins kept."""
    by = list(by)
    span = freeze(df.groupBy(*by).agg(F.min(value).alias("_min"), F.max(value).alias("_max")).where(F.col("_min").isNotNull()), "span")
    width = (F.col("_max") - F.col("_min")) / F.lit(bins)
    place = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_min")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = (
        attach(df.where(F.col(value).isNotNull()).select(*by, value), span, by, frozen=True)
        .groupBy(*by, place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = span.select(
        *by,
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        F.col("_min"),
        width.alias("_width"),
        F.lit(0).cast("long").alias("n"),
    )
    edges = grid.select(*by, "bin", "n", (F.col("_min") + F.col("_width") * F.col("bin")).alias("bin_start"))
    both = edges.unionByName(counted, allowMissingColumns=True)
    return both.groupBy(*by, "bin").agg(F.max("bin_start").alias("bin_start"), F.sum("n").alias("n"))


def box(df: DataFrame, value: str = "value", by: Sequence[str] = (SERIES,), reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (extreme points within ``reach`` quartile ranges) and number of fliers."""
    by = list(by)
    q = freeze(quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), "quartiles")
    v, span = F.col(value), F.col("q3") - F.col("q1")
    low, high = F.col("q1") - span * reach, F.col("q3") + span * reach
    return (
        attach(df.select(*by, value), q, by, frozen=True)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(v >= low, v)).alias("whisker_low"),
            F.max(F.when(v <= high, v)).alias("whisker_high"),
            F.count_if((v < low) | (v > high)).alias("fliers"),
        )
    )


def flag_fliers(
    df: DataFrame, value: str = "value", by: Sequence[str] = (SERIES,), reach: float = 1.5, name: str = "flier"
) -> DataFrame:
    """Add whether a row lies outside the whiskers."""
    by = list(by)
    q = quantiles(df, by, value, {"_q1": 0.25, "_q3": 0.75})
    span = (F.col("_q3") - F.col("_q1")) * reach
    flag = outside(value, F.col("_q1") - span, F.col("_q3") + span)
    return attach(df, q, by, how="left").withColumn(name, flag).drop("_q1", "_q3")


def fliers(df: DataFrame, value: str = "value", by: Sequence[str] = (SERIES,), reach: float = 1.5) -> DataFrame:
    """The rows outside the whiskers."""
    return flag_fliers(df, value, by, reach, "_flier").where("_flier").drop("_flier")
