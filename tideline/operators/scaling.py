"""Scaling columns per series, and back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tideline.plans import attach, freeze, quantiles
from tideline.sources.series import SERIES, value_columns

METHODS = ("standard", "minmax", "robust")


@dataclass(frozen=True)
class Scaler:
    """Standard (mean, population deviation), min–max or robust (median, quartile range) scaling."""

    columns: Sequence[str] | None = None  # by default every numeric column
    method: str = "standard"
    by: Sequence[str] = (SERIES,)

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"scaling method {self.method!r} is none of {', '.join(sorted(METHODS))}")

    def fit(self, df: DataFrame) -> ScalerModel:
        by = list(self.by)
        columns = list(self.columns or value_columns(df, by))
        if self.method == "robust":
            params = df.select(*by).distinct() if by else None
            for k, c in enumerate(columns):
                q = quantiles(df, by, c, {f"_q1{k}": 0.25, f"_center{k}": 0.5, f"_q3{k}": 0.75})
                q = q.withColumn(f"_scale{k}", F.col(f"_q3{k}") - F.col(f"_q1{k}")).drop(f"_q1{k}", f"_q3{k}")
                params = q if params is None else attach(params, q, by, how="left")
        else:
            centre, spread = {
                "standard": (F.avg, F.stddev_pop),
                "minmax": (F.min, lambda c: F.max(c) - F.min(c)),
            }[self.method]
            params = df.groupBy(*by).agg(
                *[centre(c).alias(f"_center{k}") for k, c in enumerate(columns)],
                *[spread(c).alias(f"_scale{k}") for k, c in enumerate(columns)],
            )
        for k in range(len(columns)):
            # A constant column is divided by 1.
            params = params.withColumn(f"_scale{k}", F.when(F.col(f"_scale{k}") == 0, 1.0).otherwise(F.col(f"_scale{k}")))
        return ScalerModel(tuple(columns), tuple(by), freeze(params, "scaler"))


@dataclass(frozen=True)
class ScalerModel:
    columns: tuple[str, ...]
    by: tuple[str, ...]
    params: DataFrame

    def _apply(self, df: DataFrame, change) -> DataFrame:
        # A series that was not fitted has no scale: its values become null, its rows stay.
        joined = attach(df, self.params, self.by, "left", frozen=True, row_bytes=32 * (1 + len(self.columns)))
        place = {c: k for k, c in enumerate(self.columns)}
        return joined.select(
            *[
                change(F.col(c), F.col(f"_center{place[c]}"), F.col(f"_scale{place[c]}")).alias(c) if c in place else F.col(c)
                for c in df.columns
            ]
        )

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, _scaled)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, _unscaled)


def _scaled(c: Column, center: Column, scale: Column) -> Column:
    return (c - center) / scale


def _unscaled(c: Column, center: Column, scale: Column) -> Column:
    return c * scale + center


def normalize(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "standard", by: Sequence[str] = (SERIES,)
) -> tuple[DataFrame, ScalerModel]:
    """Fit and apply in one call."""
    model = Scaler(columns, method, by).fit(df)
    return model.transform(df), model
