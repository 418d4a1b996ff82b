"""Generated series with trend, seasonality, noise and spikes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.plans import attach, freeze, with_position
from tideline.sources.series import KEY, SERIES, TRUTH, TS


def clean_value(t: Column) -> Column:
    """Level, linear trend, weekly and yearly waves at day ``t``."""
    # Level 100, slope 0.05, amplitudes 5 and 10, periods 7 and 365 days.
    weekly = F.sin(F.lit(2 * math.pi) * t / F.lit(7)) * 5.0
    yearly = F.sin(F.lit(2 * math.pi) * t / F.lit(365)) * 10.0
    return F.lit(100.0) + t * 0.05 + weekly + yearly


def with_spikes(
    days: DataFrame,
    day: str = "day",
    series: str = SERIES,
    anomaly_ratio: float = 0.02,
    noise_level: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """Give every ``(series, day)`` row a value; ``max(1, int(n·ratio))`` days of a series spike.

    Noise and spikes come from hashes of (seed, series, day), so they do not depend on how the
    rows are partitioned. A spike is 4 to 8 noise levels up or down.
    """
    if not 0 < anomaly_ratio < 1:
        raise ValueError(f"anomaly_ratio must be in (0, 1), got {anomaly_ratio}")

    def uniform(stream: str) -> Column:
        bits = F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), F.col(series), F.col(day)), F.lit(2**52))
        return (bits + 0.5) / F.lit(float(2**52))

    gauss = F.sqrt(-2 * F.log(uniform("radius"))) * F.cos(F.lit(2 * math.pi) * uniform("angle"))
    drawn = days.withColumn("_draw", uniform("draw"))
    # The spikes are the days of smallest draw.
    drawn = freeze(drawn, "days")
    sizes = drawn.groupBy(series).agg(F.count(F.lit(1)).alias("_n"))
    ranked = attach(with_position(drawn, [series], ["_draw", day], "_rank"), sizes, [series])
    spiked = F.col("_rank") < F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(anomaly_ratio)))
    size = F.when(uniform("side") < 0.5, -1.0).otherwise(1.0) * (uniform("size") * 4.0 + 4.0) * noise_level
    value = clean_value(F.col(day)) + gauss * noise_level + F.when(spiked, size).otherwise(0.0)
    return ranked.select(
        *days.columns, value.alias("value"), F.when(spiked, 1).otherwise(0).cast("tinyint").alias(TRUTH)
    )


def generate(
    spark: SparkSession,
    n_points: int = 500,
    anomaly_ratio: float = 0.02,
    noise_level: float = 2.0,
    seed: int = 42,
    n_series: int = 1,
) -> DataFrame:
    """``n_series`` daily series of ``n_points`` days from 2024-01-01."""
    if n_points < 1:
        raise ValueError(f"n_points must be at least 1, got {n_points}")
    grid = spark.range(n_points * n_series).select(
        F.format_string("series_%06d", F.floor(F.col("id") / n_points)).alias(SERIES),
        F.pmod("id", F.lit(n_points)).alias("day"),
    )
    rows = with_spikes(grid, anomaly_ratio=anomaly_ratio, noise_level=noise_level, seed=seed)
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(day as int))")
    return rows.select(SERIES, ts.alias(TS), F.col("day").alias(KEY), "value", TRUTH)
