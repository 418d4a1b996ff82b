"""Aggregates over a span of time before each row, whatever number of rows it holds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tideline.functions.scalars import micros
from tideline.plans import Swept, attach, freeze, scan
from tideline.plans.attach import join_null_safe
from tideline.sources.series import KEY, SERIES, TS

# How the parts of a frame are put together.
_PARTS = {"n": "sum", "s1": "sum", "s2": "sum", "lo": "min", "hi": "max"}


def rolling_time(
    df: DataFrame,
    value: str = "value",
    span: dt.timedelta = dt.timedelta(days=7),
    by: Sequence[str] = (SERIES,),
    order: Sequence[str] = (TS, KEY),
) -> DataFrame:
    """Count, mean, sample deviation, least and greatest value from ``span`` before each row up to its time.

    Both ends belong to the frame, and so do all rows of the same time. Nulls are not counted; a frame
    without values has count 0 and nulls, one with a single value no deviation. Rows without a time get
    nulls only. Deviations come from sums around the series' mean: a frame whose values differ by less than a
    millionth of the series' own deviation loses digits of its deviation. The new columns are ``rolling_n``, ``rolling_mean``, ``rolling_std``, ``rolling_min`` and
    ``rolling_max``; columns so called are replaced.

    Rows are put together per instant first. Time is then cut into blocks as long as the span, so that a
    frame is the end of one block and the beginning of the next: the running aggregate at the instant
    itself, and one from the frame's first instant on, for which every instant asks the block before.
    Nothing is copied or read again as frames grow, and blocks of any number of rows are cut as groups are.
    """
    by, length = list(by), round(span / dt.timedelta(microseconds=1))
    if length < 1:
        raise ValueError("span must be at least a microsecond")
    names = ["rolling_n", "rolling_mean", "rolling_std", "rolling_min", "rolling_max"]
    rows = df.drop(*names).withColumn("_t", micros(order[0]))
    x = F.col(value).cast("double")
    # Deviations from the series' mean keep the squares small; a frame's own NaN or infinity stays its own.
    usual = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    centre = freeze(rows.groupBy(*by).agg(F.coalesce(F.avg(usual), F.lit(0.0)).alias("_centre")), "centre")
    off = x - F.col("_centre")
    timed = attach(rows.where("_t IS NOT NULL").select(*by, "_t", x.alias(value)), centre, by, frozen=True)
    instants = freeze(
        timed.groupBy(*by, "_t").agg(
            F.count(value).alias("n"),
            F.coalesce(F.sum(off), F.lit(0.0)).alias("s1"),
            F.coalesce(F.sum(off * off), F.lit(0.0)).alias("s2"),
            F.min(value).alias("lo"),
            F.max(value).alias("hi"),
        ),
        "instants",
    )
    start = F.col("_t") - F.pmod("_t", F.lit(length))
    own = instants.select(*by, start.alias("_block"), "_t", F.lit(1).alias("_own"), *_PARTS)
    # Asked before the instants of the same time, to which the frame extends.
    none = [F.lit(None).cast(instants.schema[c].dataType).alias(c) for c in _PARTS]
    asked = instants.select(*by, (start - length).alias("_block"), (F.col("_t") - length).alias("_t"), F.lit(0).alias("_own"), *none)
    items = [Swept(F.col(c), f"_{side}_{c}", how, side == "from") for side in ("upto", "from") for c, how in _PARTS.items()]
    swept = scan(own.unionByName(asked), [*by, "_block"], ["_t", "_own"], items)
    is_own = F.col("_own") == 1
    halves = swept.select(
        *by,
        F.when(is_own, F.col("_t")).otherwise(F.col("_t") + length).alias("_t"),
        *[F.when(is_own, F.col(f"_upto_{c}")).otherwise(F.col(f"_from_{c}")).alias(c) for c in _PARTS],
    )
    whole = halves.groupBy(*by, "_t").agg(*[getattr(F, how)(c).alias(c) for c, how in _PARTS.items()])
    n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    square = s2 - s1 * s1 / n
    framed = attach(whole, centre, by, frozen=True).select(
        *by,
        "_t",
        n.alias("rolling_n"),
        F.when(n > 0, F.col("_centre") + s1 / n).alias("rolling_mean"),
        # Below zero is rounding, and NaN is greater than all numbers.
        F.when(n > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (n - 1))).alias("rolling_std"),
        F.col("lo").alias("rolling_min"),
        F.col("hi").alias("rolling_max"),
    )
    return join_null_safe(rows, framed, [*by, "_t"], "left").drop("_t")
