"""Ordered computations over groups of any length.

A window partitioned by series sends each series to one task. That is right while series are
short and wrong for a series that holds a large share of the data. The functions here look at
the longest group first. Short groups use an ordinary window. Otherwise the rows are range
partitioned on (group, order), which cuts a long group into chunks, and the result is put
together from per-chunk totals (running sums, fills) or from blocks that overlap by the size
of the frame (rolling aggregates, lags, sliding windows). Both ways give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tideline.plans.attach import join_null_safe
from tideline.plans.scratch import freeze
from tideline.plans.settings import setting

_START = Window.unboundedPreceding


@dataclass(frozen=True)
class Running:
    """Sum of ``value`` from the first row of the group up to this row."""

    value: Column
    name: str
    inclusive: bool = True
    backward = False

    def local(self, c: Column, w: WindowSpec) -> Column:
        return F.coalesce(F.sum(c).over(w.rowsBetween(_START, 0 if self.inclusive else -1)), F.lit(0))

    def chunk_total(self, c: Column) -> Column:
        return F.sum(c)

    def carry(self, c: Column, w: WindowSpec) -> Column:
        return F.coalesce(F.sum(c).over(w.rowsBetween(_START, -1)), F.lit(0))

    def combine(self, local: Column, carried: Column) -> Column:
        return local + carried


@dataclass(frozen=True)
class LastSeen:
    """Latest non-null ``value`` at or before this row."""

    value: Column
    name: str
    backward = False

    def local(self, c: Column, w: WindowSpec) -> Column:
        return F.last(c, ignorenulls=True).over(w.rowsBetween(_START, 0))

    def chunk_total(self, c: Column) -> Column:
        return F.max_by(c, F.when(c.isNotNull(), F.col("_at")))

    def carry(self, c: Column, w: WindowSpec) -> Column:
        return F.last(c, ignorenulls=True).over(w.rowsBetween(_START, -1))

    def combine(self, local: Column, carried: Column) -> Column:
        return F.coalesce(local, carried)


@dataclass(frozen=True)
class NextSeen(LastSeen):
    """Earliest non-null ``value`` at or after this row.

    This is the latest one in the opposite order; a frame that ends at the last row of a group
    would be computed anew for every row.
    """

    backward = True

    def chunk_total(self, c: Column) -> Column:
        return F.min_by(c, F.when(c.isNotNull(), F.col("_at")))


@dataclass(frozen=True)
class Swept:
    """``how`` (sum, min or max; nulls ignored) of ``value`` up to this row or, ``backward``, from this row on."""

    value: Column
    name: str
    how: str = "sum"
    backward: bool = False

    def local(self, c: Column, w: WindowSpec) -> Column:
        return self.chunk_total(c).over(w.rowsBetween(_START, 0))

    def chunk_total(self, c: Column) -> Column:
        return getattr(F, self.how)(c)

    def carry(self, c: Column, w: WindowSpec) -> Column:
        return self.chunk_total(c).over(w.rowsBetween(_START, -1))

    def combine(self, local: Column, carried: Column) -> Column:
        if self.how == "sum":
            return F.coalesce(local + carried, local, carried)
        return (F.least if self.how == "min" else F.greatest)(local, carried)


Item = Running | LastSeen | NextSeen | Swept


def _specs(by: Sequence[str], order: Sequence[str]) -> dict[bool, WindowSpec]:
    """Windows in the given order and, under True, in the opposite one."""
    groups = Window.partitionBy(*(by or [F.lit(0)]))
    return {False: groups.orderBy(*order), True: groups.orderBy(*[F.desc(c) for c in order])}


def long_groups(df: DataFrame, by: Sequence[str], at_most: int | None = None) -> int:
    """0 if no group is too long for one task, else the number of rows in all.

    ``at_most`` is an upper bound on the rows that the caller knows; it may spare the look.
    Counts combine before the shuffle, and only the grouping columns are read.
    """
    limit = setting(df.sparkSession, "maxGroupRows")
    if at_most is None:
        at_most = getattr(df, "_tideline_rows", None)
    if at_most is not None and at_most <= limit:
        return 0
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("longest")).first()
    return row["rows"] if (row["longest"] or 0) > limit else 0


def _lay_out(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """Write the rows in (group, order) order; ``_chunk`` is the range partition, ``_at`` the place."""
    spark = df.sparkSession
    chunks = max(2, min(setting(spark, "maxChunks"), math.ceil(rows / setting(spark, "chunkRows"))))
    laid = (
        df.repartitionByRange(chunks, *by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_chunk", F.shiftright("_at", 33))
    )
    return freeze(laid, "ordered")


def scan(
    df: DataFrame, by: Sequence[str], order: Sequence[str], items: Sequence[Item], at_most: int | None = None
) -> DataFrame:
    """Add one column per item, computed over each group in order."""
    rows = long_groups(df, by, at_most)
    if not rows:
        w = _specs(by, order)
        return df.select("*", *[i.local(i.value, w[i.backward]).alias(i.name) for i in items])
    return _scan_chunks(df, by, order, items, rows).drop("_chunk", "_at")


def _scan_chunks(df: DataFrame, by: Sequence[str], order: Sequence[str], items: Sequence[Item], rows: int) -> DataFrame:
    inputs = [f"_in{k}" for k in range(len(items))]
    laid = _lay_out(df.select("*", *[i.value.alias(c) for i, c in zip(items, inputs)]), by, order, rows)
    keys = [*by, "_chunk"]
    # One row per chunk and group: at most the number of chunks for any one group.
    totals = laid.groupBy(*keys).agg(*[i.chunk_total(F.col(c)).alias(c) for i, c in zip(items, inputs)])
    across = _specs(by, ["_chunk"])
    carries = freeze(
        totals.select(*keys, *[i.carry(F.col(c), across[i.backward]).alias(f"_carry{k}") for k, (i, c) in enumerate(zip(items, inputs))]),
        "carry",
    )
    within = _specs(keys, ["_at"])
    local = laid.select(
        *df.columns, "_chunk", "_at", *[i.local(F.col(c), within[i.backward]).alias(f"_here{k}") for k, (i, c) in enumerate(zip(items, inputs))]
    )
    joined = join_null_safe(local, carries, keys)
    return joined.select(
        *df.columns,
        "_chunk",
        "_at",
        *[i.combine(F.col(f"_here{k}"), F.col(f"_carry{k}")).alias(i.name) for k, i in enumerate(items)],
    )


def with_position(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "position", at_most: int | None = None
) -> DataFrame:
    """Number the rows of each group from 0 in order."""
    return scan(df, by, order, [Running(F.lit(1).cast("long"), name, inclusive=False)], at_most)


def framed(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    before: int,
    after: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    at_most: int | None = None,
) -> DataFrame:
    """Apply ``build`` where each row needs at most ``before`` rows back and ``after`` ahead.

    ``build`` receives the rows and an ordered window and may stack several window columns, as
    long as their combined reach stays within the two bounds.
    """
    spark = df.sparkSession
    rows = long_groups(df, by, at_most)
    if not rows:
        return build(df, _specs(by, order)[False])
    item = Running(F.lit(1).cast("long"), "_pos", inclusive=False)
    placed = _scan_chunks(df, by, order, [item], rows).drop("_chunk", "_at")
    block = max(setting(spark, "chunkRows"), 4 * (before + after), 1)
    overlapped = overlap(placed, "_pos", block, before, after)
    w = Window.partitionBy(*by, "_block").orderBy("_pos")
    return build(overlapped, w).where(F.col("_copy") == 0).drop("_pos", "_copy", "_block")


def overlap(df: DataFrame, position: str, block: int, before: int, after: int) -> DataFrame:
    """Cut groups into blocks of ``block`` positions that see their surroundings.

    Rows near the end of a block are repeated in the next one and rows near the start in the one
    before; ``_copy`` is 0 for a row in its own block. ``block`` must be at least either reach.
    """
    inside = F.pmod(position, F.lit(block))
    copies = F.array_compact(
        F.array(
            F.lit(0),
            F.when(inside >= block - before, F.lit(1)),
            F.when((inside < after) & (F.col(position) >= block), F.lit(-1)),
        )
    )
    return df.withColumn("_copy", F.explode(copies)).withColumn(
        "_block", F.floor(F.col(position) / F.lit(block)) + F.col("_copy")
    )
