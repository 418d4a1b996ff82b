"""Window reconstruction: windows that a few components cannot rebuild are anomalous."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tideline.operators.detector import Detector, DetectorModel, finish
from tideline.operators.rolling import sliding_windows
from tideline.plans import attach, freeze, quantiles
from tideline.plans.models import apply_models, fields, group_key
from tideline.plans.moments import outer_sums, window_sums


class WindowReconstruction(Detector):
    """Linear autoencoder over sliding windows.

    The best linear encoder and decoder are the leading principal components, which follow from
    sums of outer products of windows; these come from products of rows a lag apart, so windows are
    not laid out for training. Results are keyed by the last row of a window.
    With ``windowed`` the input is an array column that already holds one window per row.
    """

    def __init__(
        self,
        name: str = "WindowReconstruction",
        window_size: int = 30,
        n_components: int = 5,
        threshold_percentile: float = 95,
        windowed: bool = False,
        short: str = "skip",
        **keys: Any,
    ) -> None:
        super().__init__(name, **keys)
        if not 0 <= threshold_percentile <= 100:
            raise ValueError("threshold_percentile must be in [0, 100]")
        self.window_size, self.n_components = window_size, n_components
        self.threshold_percentile, self.windowed, self.short = threshold_percentile, windowed, short

    def windows(self, df: DataFrame) -> DataFrame:
        """One flattened window per row."""
        if self.windowed:
            name = self.inputs[0]
            nested = dict(df.dtypes)[name].startswith("array<array")
            flat = F.flatten(name) if nested else F.col(name)
            return df.select(*self.by, *self.order, flat.cast("array<double>").alias("_w"))
        rows = sliding_windows(df, self.inputs, self.window_size, self.by, self.order, self.short)
        flat = F.flatten("window")
        # A window with a missing value has no verdict.
        whole = F.forall(flat, lambda c: c.isNotNull())
        return rows.select(*self.by, *self.order, F.when(whole, flat).alias("_w"))

    def fit(self, df: DataFrame) -> WindowReconstructionModel:
        by, wanted = self.by, self.n_components
        windows = self.windows(df)
        if self.windowed:
            windows = freeze(windows, "windows")
            sums = outer_sums(windows.select(*by, F.concat(F.array(F.lit(1.0)), "_w").alias("_z")), by, "_z")
        else:
            step = F.array(*[F.col(c).cast("double") for c in self.inputs])
            whole = F.forall(step, lambda c: c.isNotNull())
            rows = df.select(*by, *self.order, F.when(whole, step).alias("_x"))
            sums = window_sums(rows, by, self.order, "_x", self.window_size)

        def solve(group: pd.DataFrame) -> pd.DataFrame:
            flat = np.zeros(int(group["i"].max()) + 1)
            flat[group["i"].to_numpy()] = group["total"].to_numpy()
            m = flat.reshape(int(round(len(flat) ** 0.5)), -1)
            mean = m[0, 1:] / m[0, 0]
            cov = m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
            _, vectors = np.linalg.eigh((cov + cov.T) / 2)
            basis = vectors[:, ::-1][:, : min(wanted, len(mean))]
            first = group.head(1)[by].reset_index(drop=True) if by else pd.DataFrame(index=[0])
            return first.assign(mean=[mean.tolist()], basis=[basis.ravel().tolist()])

        schema = ", ".join([*([fields(sums, by)] if by else []), "mean array<double>", "basis array<double>"])
        models = freeze(sums.withColumn("_g", group_key(by)).groupBy("_g").applyInPandas(solve, schema), "basis")
        model = WindowReconstructionModel(self.name, self, models, None)
        errors = freeze(model.errors_of(windows).select(*by, "_raw"), "errors")
        cut = quantiles(errors, by, "_raw", {"_cut": self.threshold_percentile / 100})
        return WindowReconstructionModel(self.name, self, models, freeze(cut, "threshold"))


def rebuild_error(x: np.ndarray, model: dict[str, Any]) -> np.ndarray:
    """Mean squared difference between windows and what the components rebuild."""
    mean = np.asarray(model["mean"][0])
    basis = np.asarray(model["basis"][0]).reshape(len(mean), -1)
    c = x - mean
    return ((c - (c @ basis) @ basis.T) ** 2).mean(axis=1)


@dataclass(frozen=True)
class WindowReconstructionModel(DetectorModel):
    name: str
    spec: WindowReconstruction
    models: DataFrame
    thresholds: DataFrame | None
    keeps_rows = False

    def errors(self, df: DataFrame) -> DataFrame:
        return self.errors_of(self.spec.windows(df))

    def errors_of(self, windows: DataFrame) -> DataFrame:
        size = 8 * (self.spec.n_components + 1) * self.spec.window_size * max(1, len(self.spec.inputs)) + 64
        return apply_models(windows, self.spec.by, "_w", self.models, rebuild_error, "_raw", size).drop("_w")

    def transform(self, df: DataFrame) -> DataFrame:
        return finish(attach(self.errors(df), self.thresholds, self.spec.by, how="left", frozen=True), centred=False)
