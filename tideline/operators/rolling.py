"""Rolling aggregates, lags, calendar features and sliding windows, all counted in rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tideline.functions.labels import outside
from tideline.functions.scalars import day_of_week, month
from tideline.plans import framed, with_position
from tideline.sources.series import KEY, SERIES, TS, value_columns

# Rolling lengths and lags of the feature set.
ROLLING, LAGS = (7, 30), (1, 7)


def add_features(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (SERIES,),
    order: Sequence[str] = (TS, KEY),
) -> DataFrame:
    """Rolling mean and sample deviation, lags, weekday and month, by default of every numeric column."""
    ts = order[0]
    columns = list(columns or value_columns(df, [*by, *order]))

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        extra: list[Column] = []
        for c in columns:
            for n in ROLLING:
                frame = w.rowsBetween(1 - n, 0)
                extra.append(F.avg(c).over(frame).alias(f"{c}_rolling_mean_{n}"))
                extra.append(F.stddev_samp(c).over(frame).alias(f"{c}_rolling_std_{n}"))
            extra += [F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for k in LAGS]
        return rows.select("*", *extra)

    out = framed(df, list(by), list(order), max(*ROLLING, *LAGS), 0, build)
    return out.select("*", day_of_week(ts).alias("day_of_week"), month(ts).alias("month"))


def rolling_band(
    df: DataFrame,
    value: str = "value",
    n: int = 30,
    sigmas: float = 2.0,
    by: Sequence[str] = (SERIES,),
    order: Sequence[str] = (TS, KEY),
) -> DataFrame:
    """Rolling mean ± ``sigmas`` deviations over full windows, and whether the value leaves it."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(1 - n, 0)
        full = F.count(value).over(frame) == n
        return rows.select(
            "*",
            F.when(full, F.avg(value).over(frame)).alias("rolling_mean"),
            F.when(full, F.stddev_samp(value).over(frame)).alias("rolling_std"),
        )

    out = framed(df, list(by), list(order), n - 1, 0, build)
    half = F.col("rolling_std") * F.lit(float(sigmas))
    return (
        out.withColumn("band_lower", F.col("rolling_mean") - half)
        .withColumn("band_upper", F.col("rolling_mean") + half)
        .withColumn("outside_band", outside(value, "band_lower", "band_upper"))
    )


def sliding_windows(
    df: DataFrame,
    columns: Sequence[str],
    window_size: int = 30,
    by: Sequence[str] = (SERIES,),
    order: Sequence[str] = (TS, KEY),
    short: str = "skip",
) -> DataFrame:
    """One row per full window, keyed by its last row: ``window`` holds the steps in order.

    A series of n rows gives n − w + 1 windows. Series shorter than the window give none
    (``short="skip"``) or raise (``short="error"``).
    """
    if window_size < 1:
        raise ValueError("window_size must be at least 1")
    by, order = list(by), list(order)
    if short == "error":
        too_short = df.groupBy(*by).count().where(F.col("count") < window_size)
        if not too_short.isEmpty():
            raise ValueError(f"a series has fewer rows than window_size = {window_size}")
    step = F.array(*[F.col(c).cast("double") for c in columns])

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.select("*", F.collect_list(step).over(w.rowsBetween(1 - window_size, 0)).alias("window"))

    kept = list(dict.fromkeys([*by, *order, *columns]))
    out = framed(df.select(*kept), by, order, window_size - 1, 0, build)
    return out.where(F.size("window") == window_size).select(*by, *order, "window")


def short_series(df: DataFrame, window_size: int, by: Sequence[str] = (SERIES,)) -> DataFrame:
    """The series that have too few rows for one window."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") < window_size)


def row_position(df: DataFrame, by: Sequence[str] = (SERIES,), order: Sequence[str] = (TS, KEY)) -> DataFrame:
    return with_position(df, list(by), list(order), "position")


def first_rows(df: DataFrame, n: int = 20, by: Sequence[str] = (SERIES,), order: Sequence[str] = (TS, KEY)) -> DataFrame:
    """The first ``n`` rows of every series; tasks keep only ``n`` rows per series before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
