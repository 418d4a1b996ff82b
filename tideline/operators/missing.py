"""Filling or dropping missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.scalars import micros
from tideline.plans import LastSeen, NextSeen, scan
from tideline.sources.series import KEY, SERIES, TS

STRATEGIES = ("interpolate", "ffill", "bfill", "drop")


def handle_missing(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str = "interpolate",
    by: Sequence[str] = (SERIES,),
    order: Sequence[str] = (TS, KEY),
) -> DataFrame:
    """Fill the nulls of ``columns`` within each series, or drop rows that have any.

    ``interpolate`` is linear in time between the neighbouring values; at the ends the nearest
    value is used.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy!r} is no way to treat missing values; there are {', '.join(STRATEGIES)}")
    if strategy == "drop":
        return df.na.drop(subset=list(columns))
    by, order = list(by), list(order)
    kept = df.columns
    items, filled = [], {}
    for k, c in enumerate(columns):
        point = F.when(F.col(c).isNotNull(), F.struct(micros(order[0]).alias("t"), F.col(c).alias("v")))
        if strategy != "bfill":
            items.append(LastSeen(point, f"_prev{k}"))
        if strategy != "ffill":
            items.append(NextSeen(point, f"_next{k}"))
        filled[c] = _filled(c, k, strategy, order[0])
    wide = scan(df, by, order, items)
    return wide.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in kept])


def _filled(c: str, k: int, strategy: str, ts: str) -> Column:
    prev, nxt = F.col(f"_prev{k}"), F.col(f"_next{k}")
    if strategy == "ffill":
        return prev["v"]
    if strategy == "bfill":
        return nxt["v"]
    share = (micros(ts) - prev["t"]) / F.nullif(nxt["t"] - prev["t"], F.lit(0).cast("long"))
    between = prev["v"] + (nxt["v"] - prev["v"]) * share
    return F.coalesce(F.col(c), between, prev["v"], nxt["v"])
