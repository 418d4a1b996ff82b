"""Anomaly labels: −1 is an anomaly and 1 is normal, unless a format says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ANOMALY, NORMAL = -1, 1
FORMATS = ("pm1", "zero_is_anomaly", "one_is_anomaly", "bool")


def is_anomaly(c: Column | str, label_format: str = "pm1") -> Column:
    """Boolean: does the label mean an anomaly?"""
    c = F.col(c) if isinstance(c, str) else c
    if label_format == "pm1":
        return c == ANOMALY
    if label_format == "zero_is_anomaly":
        return c == 0
    if label_format == "one_is_anomaly":
        return c == 1
    if label_format == "bool":
        return c.cast("boolean")
    raise ValueError(f"unknown label format {label_format!r}; choose from {FORMATS}")


def to_label(flag: Column) -> Column:
    """−1 where the flag holds, 1 elsewhere; no verdict where the flag is null."""
    return F.when(flag, F.lit(ANOMALY)).when(~flag, F.lit(NORMAL)).cast("int")


def convert(c: Column | str, label_format: str) -> Column:
    return to_label(is_anomaly(c, label_format))


def resolve_format(df: DataFrame, truth: str, label_format: str = "auto") -> str:
    """``auto``: labels that are all 0 or 1 count 0 as the anomaly, anything else is −1/1."""
    if label_format != "auto":
        is_anomaly(F.lit(0), label_format)
        return label_format
    plain = df.agg(F.every(F.col(truth).isin(0, 1)).alias("z")).first()["z"]
    return "zero_is_anomaly" if plain else "pm1"


def outside(value: Column | str, lower: Column | str, upper: Column | str) -> Column:
    """Is the value outside the interval? A missing value or bound is never outside."""
    value, lower, upper = (F.col(c) if isinstance(c, str) else c for c in (value, lower, upper))
    return F.coalesce((value < lower) | (value > upper), F.lit(False))


def threshold_side(score: Column | str, threshold: Column | float) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(score < threshold, "normal").otherwise("above")
