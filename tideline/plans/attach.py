"""Joining a table of per-group parameters back to the rows of the groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tideline.plans.scratch import freeze, rows_of
from tideline.plans.settings import setting


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key, keeping one copy of the keys."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def attach(
    df: DataFrame,
    params: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    row_bytes: int = 128,
    frozen: bool = False,
    at_most: int | None = None,
    repeated: bool = True,
) -> DataFrame:
    """Join ``params`` (one row per group) to ``df`` without moving ``df`` by its group.

    Small parameter tables are broadcast. The size is known from ``at_most``, a bound on the rows
    the caller can vouch for, or by writing the table first. Larger tables are repeated over a
    fixed number of salts, so that a group holding a large share of the rows is spread over that
    many tasks. Tables too large to repeat (one row per distinct value, say), or not to be
    ``repeated`` as their rows are long, are joined as they are; adaptive execution then splits
    just the partitions that turn out large.
    """
    spark = df.sparkSession
    limit = setting(spark, "broadcastBytes")
    if not on:
        # One group: a single row of parameters.
        return df.join(F.broadcast(params.limit(1)), F.lit(True), how)
    if not frozen and at_most is not None and at_most * row_bytes <= limit:
        return join_null_safe(df, F.broadcast(params), on, how)
    if not frozen:
        params = freeze(params, "params")
    if rows_of(params) * row_bytes <= limit:
        return join_null_safe(df, F.broadcast(params), on, how)
    if not repeated or rows_of(params) > setting(spark, "saltedRows"):
        return join_null_safe(df, params, on, how)
    salts = setting(spark, "salts")
    spread = [c for c, t in df.dtypes if not t.startswith("map")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join_null_safe(salted, copies, [*on, "_salt"], how).drop("_salt")
