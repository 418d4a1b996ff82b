"""Quantiles from sketches that are kept and merged: near ones, over any number of rows and days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def rank_error(k: int) -> float:
    """How far the rank of a quantile may be off, as a share of the rows, in 99 of 100 sketches of size ``k``.

    The published fit of this error for sketches of compactors (KLL), of one rank.
    """
    return 2.296 / k**0.9723


def sketches(df: DataFrame, by: Sequence[str], value: str, k: int = 400) -> DataFrame:
    """One row per group with ``sketch``, of bounded size, and ``n_values``; nulls and NaN are left out.

    Tasks pass on one sketch per group, so a group of any number of rows costs the same to move.
    The rows can be written and merged later, with those of other days.
    """
    if not 8 <= k <= 65535:
        raise ValueError("k must be from 8 to 65535")
    x = F.col(value).cast("double")
    seen = F.when(~F.isnan(x), x)
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(seen, F.lit(k)).alias("sketch"), F.count(seen).alias("n_values"))


def merged(parts: DataFrame, by: Sequence[str], k: int = 400) -> DataFrame:
    """Sketches of finer groups put together; the error stays that of one sketch of all their rows."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n_values").alias("n_values"))


def near_quantiles(parts: DataFrame, by: Sequence[str], wanted: Mapping[str, float]) -> DataFrame:
    """One row per sketch with values of about the wanted ranks, each one of the values seen; null without values."""
    picked = [
        F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).alias(name)
        for name, q in wanted.items()
    ]
    return parts.select(*by, *picked)
