"""Exact quantiles with linear interpolation, for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tideline.plans.attach import attach
from tideline.plans.ordered import Running, long_groups, scan
from tideline.plans.scratch import freeze, rows_of
from tideline.plans.sketches import near_quantiles, sketches


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    weight: str | None = None,
    at_most: int | None = None,
    exact: bool = True,
    k: int = 400,
) -> DataFrame:
    """One row per group with the wanted quantiles of ``value`` (nulls ignored).

    ``weight`` names a column saying how many rows a row stands for.

    Spark's exact aggregate keeps every distinct value of a group in one task, so it is used
    only for bounded groups. Larger ones are reduced to counts per distinct value, ranked by
    running sums, and the two values around each wanted rank are picked.

    With ``exact=False`` they come from sketches of size ``k``, in one pass that combines before the
    shuffle: values seen whose ranks are off by at most ``sketches.rank_error(k)`` of the rows.
    """
    if not exact:
        if weight is not None:
            raise ValueError("sketches count every row once; weight needs exact=True")
        return near_quantiles(sketches(df, by, value, k), by, wanted)
    times = F.col(weight) if weight else F.lit(1).cast("long")
    present = df.where(F.col(value).isNotNull()).select(*by, value, times.alias("_w"))
    if not long_groups(present, by, getattr(df, "_tideline_rows", None) if at_most is None else at_most):
        return present.groupBy(*by).agg(*[F.percentile(value, F.lit(float(q)), F.col("_w")).alias(n) for n, q in wanted.items()])
    counts = freeze(present.groupBy(*by, value).agg(F.sum("_w").alias("_n")), "counts")
    ranked = scan(counts, by, [value], [Running(F.col("_n"), "_hi")], rows_of(counts)).withColumn("_lo", F.col("_hi") - F.col("_n"))
    sized = attach(ranked, counts.groupBy(*by).agg(F.sum("_n").alias("_total")), by)
    picks, results = [], []
    for k, (name, q) in enumerate(wanted.items()):
        rank = F.lit(float(q)) * (F.col("_total") - 1)
        for side, place in (("l", F.floor(rank)), ("u", F.ceil(rank))):
            hit = (F.col("_lo") <= place) & (place < F.col("_hi"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}{k}"))
        share = F.lit(float(q)) * (F.col("_total") - 1) - F.floor(F.lit(float(q)) * (F.col("_total") - 1))
        results.append((F.col(f"_l{k}") + (F.col(f"_u{k}") - F.col(f"_l{k}")) * share).alias(name))
    picked = sized.groupBy(*by).agg(F.max("_total").alias("_total"), *picks)
    return picked.select(*by, *results)
