"""The rows of least value, an exact number per group, without sorting long groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tideline.plans.attach import attach
from tideline.plans.ordered import with_position
from tideline.plans.scratch import freeze, rows_of
from tideline.plans.settings import setting

_BINS = 1024


def smallest(
    df: DataFrame, by: Sequence[str], value: str, ties: Sequence[str], sizes: DataFrame, count: str, longest: int
) -> DataFrame:
    """The rows that come first by ``value``, then ``ties``: in each group as many as ``count`` in ``sizes`` says.

    ``sizes`` is a written table with a row per group, ``longest`` a bound on the rows of a group. Groups that
    fit a task are ranked there. For longer ones the value at that rank is closed in by counting: each pass
    counts the rows of ``_BINS`` equal parts of the range that holds it, before the shuffle, and the part that
    it is in is the next range. Only rows in a range small enough for a task, or all of one value, are ordered.
    Rows without a value are left out; not-a-number counts as infinite.
    """
    asked, groups, columns = sizes.select(*by, F.col(count).alias("_left")), rows_of(sizes), df.columns
    limit = setting(df.sparkSession, "maxGroupRows")
    df = df.where(F.col(value).isNotNull()).withColumn("_at", F.when(F.isnan(value), float("inf")).otherwise(F.col(value)))
    if longest <= limit:
        placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_at", *ties)))
        return attach(placed, asked, by, at_most=groups).where("_place <= _left").select(*columns)
    df = freeze(df, "values")
    at, low, high = F.col("_at"), F.col("_low"), F.col("_high")
    spans = df.groupBy(*by).agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"), F.count(F.lit(1)).alias("_inside"))
    spans = attach(spans, asked, by, at_most=groups).withColumn("_left", F.least("_left", "_inside"))
    while True:
        spans = freeze(spans.select(*by, "_low", "_high", "_inside", "_left"), "spans")
        wide = spans.agg(F.max(F.when((low < high) & (F.col("_inside") > limit), F.col("_inside"))), F.max("_inside")).first()
        if wide[0] is None:
            break
        # The least and the greatest value of a range never share a bin, so every pass narrows it.
        share = F.try_divide(at - low, high - low)
        part = F.when(F.isnan(share) | (low == high), F.lit(_BINS - 1)).otherwise(F.least(F.floor(share * _BINS), F.lit(_BINS - 1)))
        inside = attach(df.select(*by, "_at"), spans, by, frozen=True).where(at.between(low, high))
        bins = inside.groupBy(*by, part.cast("int").alias("_bin"), "_left").agg(
            F.min("_at").alias("_low"), F.max("_at").alias("_high"), F.count(F.lit(1)).alias("_inside")
        )
        # At most ``_BINS`` rows of a group.
        upto = F.sum("_inside").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bin"))
        bins = bins.withColumn("_before", upto - F.col("_inside")).where("_before < _left and _left <= _before + _inside")
        spans = bins.withColumn("_left", F.col("_left") - F.col("_before"))
    met = attach(df, spans, by, frozen=True)
    edge = with_position(met.where(at.between(low, high)), by, ["_at", *ties], "_place", wide[1])
    return met.where(at < low).select(*columns).unionByName(edge.where("_place < _left").select(*columns))
