"""Forecasting by trend and seasonal terms, with intervals and interval-based flags."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.functions.labels import outside
from tideline.functions.scalars import micros
from tideline.plans import attach, freeze, rows_of
from tideline.plans.attach import join_null_safe
from tideline.plans.models import fields, group_key, uniform
from tideline.plans.moments import outer_sums
from tideline.sources.series import KEY, SERIES, TS

_DAY = 86_400_000_000

# Changepoints lie in the first 80 % of the span; days and orders of the seasons.
CHANGEPOINT_RANGE = 0.8
YEARLY, WEEKLY = (365.25, 10), (7.0, 3)


@dataclass(frozen=True)
class Forecaster:
    """Piecewise linear trend plus Fourier seasons, fitted by penalised regression per series.

    ``changepoint_prior_scale`` and ``season_prior_scale`` are the widths of the priors on slope
    changes and on seasonal terms. Slope changes have normal priors, which make all of them small,
    or with ``changepoint_prior="laplace"`` double exponential ones, which leave most of them at zero. Yearly and weekly seasons may be switched off or given an order.
    """

    changepoint_prior_scale: float = 0.05
    seasonality_mode: str = "additive"
    interval_width: float = 0.95
    yearly_seasonality: bool | int = True
    weekly_seasonality: bool | int = True
    n_changepoints: int = 25
    season_prior_scale: float = 10.0
    # Rounds that settle priors against noise within a solve, and trend against season (two passes each). A series
    # that takes more keeps its last estimate, is not ``settled`` in the model, and is warned about.
    max_rounds: int = 1000
    max_alternations: int = 50
    value: str = "value"
    by: Sequence[str] = (SERIES,)
    order: Sequence[str] = (TS, KEY)
    changepoint_prior: str = "normal"

    def __post_init__(self) -> None:
        if self.changepoint_prior not in ("normal", "laplace"):
            raise ValueError("changepoint_prior must be 'normal' or 'laplace'")
        if self.max_rounds < 1 or self.max_alternations < 1:
            raise ValueError("max_rounds and max_alternations must be at least 1")
        if self.seasonality_mode not in ("additive", "multiplicative"):
            raise ValueError("seasonality_mode must be 'additive' or 'multiplicative'")
        if not 0 < self.interval_width < 1:
            raise ValueError("interval_width must be in (0, 1)")

    @property
    def ts(self) -> str:
        return self.order[0]

    def seasons(self) -> list[tuple[float, int]]:
        out = []
        for wanted, (period, usual) in ((self.yearly_seasonality, YEARLY), (self.weekly_seasonality, WEEKLY)):
            if wanted:
                out.append((period, usual if wanted is True else int(wanted)))
        return out

    def trend_terms(self, scaled: Column) -> Column:
        """1, t and one hinge per changepoint, for time scaled to [0, 1] over the history."""
        places = [CHANGEPOINT_RANGE * (j + 1) / (self.n_changepoints + 1) for j in range(self.n_changepoints)]
        # Scaled time may lie beyond 1, never below the first changepoint's hinge.
        return F.array(F.lit(1.0), scaled, *[F.greatest(scaled - F.lit(s), F.lit(0.0)) for s in places])

    def season_terms(self, ts: Column) -> Column:
        days = micros(ts) / F.lit(float(_DAY))
        terms = []
        for period, order in self.seasons():
            for k in range(1, order + 1):
                angle = days * F.lit(2 * math.pi * k / period)
                terms += [F.sin(angle), F.cos(angle)]
        return F.array(*terms) if terms else F.array().cast("array<double>")

    def fit(self, df: DataFrame) -> ForecastModel:
        if self.value not in df.columns or self.ts not in df.columns:
            raise ValueError(f"columns {self.ts!r} and {self.value!r} are needed")
        by, y = list(self.by), F.col(self.value)
        seen = df.where(y.isNotNull())
        scale = freeze(
            seen.groupBy(*by).agg(
                F.min(micros(self.ts)).alias("_t0"),
                F.max(micros(self.ts)).alias("_t1"),
                F.greatest(F.max(F.abs(y)), F.lit(1e-12)).alias("_size"),
                F.avg(y).alias("_mean"),
            ),
            "scale",
        )
        additive = self.seasonality_mode == "additive" or not self.seasons()
        if additive:
            # The intercept has no prior, so the mean can be taken out first; what is small beside it stays exact.
            target = (y - F.col("_mean")) / F.col("_size")
        else:
            scale = scale.withColumn("_mean", F.lit(0.0))
            target = y / F.col("_size")
        rows = attach(seen, scale, by, frozen=additive).select(
            *by,
            self.trend_terms(_scaled_time(self.ts)).alias("_trend"),
            self.season_terms(F.col(self.ts)).alias("_season"),
            target.alias("_y"),
        )
        n_trend = self.n_changepoints + 2
        n_season = 2 * sum(order for _, order in self.seasons())
        # Negative numbers stand for the slope of a double exponential prior's logarithm.
        tight = 1 / self.changepoint_prior_scale
        priors = [0.0, 0.0] + [tight**2 if self.changepoint_prior == "normal" else -tight] * self.n_changepoints
        season_priors = [1 / self.season_prior_scale**2] * n_season
        if additive:
            fitted = _ridge(rows.select(*by, F.concat("_trend", "_season", F.array("_y")).alias("_z")), by, priors + season_priors, self.max_rounds)
        else:
            fitted = self._fit_multiplicative(rows, by, priors, season_priors)
        model = attach(fitted, scale, by, frozen=additive).select(
            *by, "_t0", "_t1", "_size", "_mean",
            F.slice("_beta", 1, n_trend).alias("_trend_beta"),
            F.slice("_beta", n_trend + 1, n_season).alias("_season_beta") if n_season else F.array().cast("array<double>").alias("_season_beta"),
            "_sigma", "_slope_step", "_settled",
        )
        model = ForecastModel(self, freeze(model, "forecast"))
        if left := model.unsettled().count():
            warnings.warn(f"{left} series have not settled; raise max_rounds or max_alternations", stacklevel=2)
        return model

    def _fit_multiplicative(self, rows: DataFrame, by: list[str], priors: list[float], season_priors: list[float]) -> DataFrame:
        """y = trend · (1 + season): trend and season are fitted in turn, each given the other.

        A series leaves the rounds once its deviation has settled; the others go on without it.
        """
        rows = freeze(rows, "design")
        width = 16 * (len(priors) + len(season_priors))
        first = _ridge(rows.select(*by, F.concat("_trend", F.array("_y")).alias("_z")), by, priors, self.max_rounds)
        active = first.select(*by, F.col("_beta").alias("_tb"), F.col("_sigma").alias("_before"))
        groups = rows_of(first)
        done: list[DataFrame] = []
        for _ in range(self.max_alternations):
            level = attach(rows, active.select(*by, "_tb"), by, row_bytes=width, at_most=groups).withColumn("_level", _dot("_trend", "_tb"))
            scaled = F.transform("_season", lambda s: s * F.col("_level"))
            season = _ridge(level.select(*by, F.concat(scaled, F.array(F.col("_y") - F.col("_level"))).alias("_z")), by, season_priors, self.max_rounds)
            season = season.select(*by, F.col("_beta").alias("_sb"), F.col("_settled").alias("_season_settled"))
            wave = attach(rows, season.select(*by, "_sb"), by, row_bytes=width, at_most=groups).withColumn("_wave", 1.0 + _dot("_season", "_sb"))
            scaled = F.transform("_trend", lambda s: s * F.col("_wave"))
            trend = _ridge(wave.select(*by, F.concat(scaled, F.array("_y")).alias("_z")), by, priors, self.max_rounds)
            both = attach(attach(trend, season, by, row_bytes=width, at_most=groups), active.select(*by, "_before"), by, row_bytes=64, at_most=groups)
            still = F.abs(F.col("_sigma") - F.col("_before")) <= 1e-3 * F.greatest("_before", F.lit(1e-12))
            state = both.select(
                *by, F.col("_beta").alias("_tb"), "_sb", F.col("_sigma").alias("_before"), "_slope_step",
                (still & F.col("_settled") & F.col("_season_settled")).alias("_settled"),
            )
            state = freeze(state, "state")
            done.append(state.where("_settled"))
            active = state.where("not _settled")
            groups = active.count()
            if not groups:
                break
        both = active
        for settled in done:
            both = both.unionByName(settled)
        both = freeze(both.drop("_before"), "both")
        # The deviation is taken from the residuals themselves.
        fitted = attach(rows, both, by, row_bytes=width, frozen=True)
        rest = F.col("_y") - _dot("_trend", "_tb") * (1.0 + _dot("_season", "_sb"))
        sigma = fitted.groupBy(*by).agg(F.sqrt(F.avg(rest * rest)).alias("_sigma"))
        joined = attach(both, sigma, by, at_most=rows_of(both))
        return joined.select(*by, F.concat("_tb", "_sb").alias("_beta"), "_sigma", "_slope_step", "_settled")

    def detect_anomalies(self, df: DataFrame) -> DataFrame:
        """Fit, forecast the same rows, and flag values outside the interval."""
        out = self.fit(df).in_sample(df)
        return out.withColumn("is_anomaly", F.coalesce(outside(self.value, "yhat_lower", "yhat_upper"), F.lit(False)))


def _scaled_time(ts: str) -> Column:
    return (micros(ts) - F.col("_t0")) / F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1)).cast("double")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


# How far a gradient may be from what its penalty allows, as a share of the penalty.
OPTIMAL = 1e-6


def _sparse_solve(
    gram: np.ndarray, target: np.ndarray, ridge: np.ndarray, sparse: np.ndarray, penalty: np.ndarray, start: np.ndarray, max_rounds: int
) -> tuple[np.ndarray, bool]:
    """The least of ½β'Gβ − t'β + ½Σ ridge·β² + Σ penalty·|β| (this over ``sparse``), and whether it was reached.

    Terms without an absolute penalty are solved for exactly and leave a problem in the sparse ones alone.
    There, rounds of coordinate descent find which are not zero and their signs; solving for those settles
    the rest. It is the least once every gradient is what its penalty allows: equal to it, with the
    opposite sign, where a coefficient is not zero, and within it elsewhere.
    """
    full = gram + np.diag(ridge)
    dense = ~sparse
    # What the other terms explain, taken out of the sparse ones and of the target.
    share = np.linalg.lstsq(full[np.ix_(dense, dense)], np.column_stack([full[np.ix_(dense, sparse)], target[dense]]), rcond=None)[0]
    g = full[np.ix_(sparse, sparse)] - full[np.ix_(sparse, dense)] @ share[:, :-1]
    t = target[sparse] - full[np.ix_(sparse, dense)] @ share[:, -1]
    bound, beta, reached = penalty[sparse], start[sparse].copy(), False
    # A term that the others make up altogether cannot be told from them and stays at zero.
    least = 1e-12 * np.diag(full)[sparse]
    usable = np.diag(g) > least
    beta[~usable] = 0.0

    def off(b: np.ndarray) -> float:
        slope = g @ b - t
        miss = np.where(b != 0, np.abs(slope + bound * np.sign(b)), np.maximum(np.abs(slope) - bound, 0.0))
        return float((miss / bound)[usable].max(initial=0.0))

    for _ in range(max_rounds):
        for j in np.flatnonzero(usable):
            pull = t[j] - g[j] @ beta + g[j, j] * beta[j]
            beta[j] = np.sign(pull) * max(abs(pull) - bound[j], 0.0) / g[j, j]
        on = np.flatnonzero(beta)
        exact = np.zeros_like(beta)
        if len(on):
            exact[on] = np.linalg.lstsq(g[np.ix_(on, on)], t[on] - bound[on] * np.sign(beta[on]), rcond=None)[0]
        if (np.sign(exact) == np.sign(beta)).all() and off(exact) <= OPTIMAL:
            beta, reached = exact, True
            break
    out = np.zeros(len(target))
    out[sparse] = beta
    out[dense] = share[:, -1] - share[:, :-1] @ beta
    return out, reached


def _ridge(rows: DataFrame, by: list[str], priors: list[float], max_rounds: int) -> DataFrame:
    """Coefficients and residual deviation per series; ``_z`` holds the terms and, last, the target.

    Only the summed outer products reach the solving task. Residual deviation and coefficients
    follow from them, so the rows are read once.
    """
    sums = outer_sums(rows.withColumn("_z", F.concat("_z", F.array(F.lit(1.0)))), by, "_z").withColumn("_g", group_key(by))
    size = len(priors)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        flat = np.zeros((size + 2) ** 2)
        flat[group["i"].to_numpy()] = group["total"].to_numpy()
        m = flat.reshape(size + 2, size + 2)
        gram, target, yy, n = m[:size, :size], m[:size, size], m[size, size], m[-1, -1]
        # Nothing below the rounding of the sums counts as noise.
        least = max(1e-14 * yy / n, 1e-300)
        noise = max(yy / n - (m[size, -1] / n) ** 2, least)
        beta, settled, optimal = np.zeros(size), False, True
        weights = np.asarray(priors, dtype=float)
        sparse = weights < 0
        # The weight of the priors depends on the noise and the noise on the fit: settle both.
        for _ in range(max_rounds):
            if sparse.any():
                beta, optimal = _sparse_solve(gram, target, np.where(sparse, 0.0, weights) * noise, sparse, -weights * noise, beta, max_rounds)
            else:
                beta = np.linalg.lstsq(gram + np.diag(weights * noise), target, rcond=None)[0]
            rest = max((yy - 2 * beta @ target + beta @ gram @ beta) / n, least)
            settled = optimal and abs(rest - noise) <= 1e-9 * noise
            if settled:
                break
            noise = rest
        first = group.head(1)[by].reset_index(drop=True) if by else pd.DataFrame(index=[0])
        hinges = beta[2:] if size > 2 else np.zeros(0)
        step = float(np.sqrt((hinges**2).mean())) if len(hinges) else 0.0
        return first.assign(_beta=[beta.tolist()], _sigma=float(np.sqrt(noise)), _slope_step=step, _settled=bool(settled))

    schema = ", ".join([*([fields(sums, by)] if by else []), "_beta array<double>", "_sigma double", "_slope_step double", "_settled boolean"])
    return freeze(sums.groupBy("_g").applyInPandas(solve, schema), "ridge")


@dataclass(frozen=True)
class ForecastModel:
    spec: Forecaster
    params: DataFrame

    def unsettled(self) -> DataFrame:
        """The series whose fit was ended before it had settled."""
        return self.params.where("not _settled").select(*self.spec.by)

    def _predict(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        spec = self.spec
        by = list(spec.by)
        width = 16 * (spec.n_changepoints + 2 + 2 * sum(o for _, o in spec.seasons()) + 8)
        wide = attach(rows, self.params, by, how, frozen=True, row_bytes=width)
        t = _scaled_time(spec.ts)
        wide = wide.withColumn("_trend", spec.trend_terms(t)).withColumn("_season", spec.season_terms(F.col(spec.ts)))
        trend, season = _dot("_trend", "_trend_beta"), _dot("_season", "_season_beta")
        fitted = trend + season if spec.seasonality_mode == "additive" else trend * (1.0 + season)
        # Beyond the history the slope may change as it did before: variance of future hinges.
        ahead = F.greatest(t - 1.0, F.lit(0.0))
        rate = F.lit(spec.n_changepoints / CHANGEPOINT_RANGE)
        drift = F.col("_slope_step") * F.col("_slope_step") * rate * ahead * ahead * ahead / 3.0
        half = F.lit(NormalDist().inv_cdf(0.5 + spec.interval_width / 2)) * F.sqrt(F.col("_sigma") * F.col("_sigma") + drift)
        size, mean = F.col("_size"), F.col("_mean")
        return wide.select(
            *rows.columns,
            (fitted * size + mean).alias("yhat"),
            ((fitted - half) * size + mean).alias("yhat_lower"),
            ((fitted + half) * size + mean).alias("yhat_upper"),
        )

    def slope_changes(self, df: DataFrame) -> DataFrame:
        """One row per series and changepoint: when the slope changes, by how much a day, and its gradient.

        ``gradient`` is taken from the residuals of ``df``, the rows of the fit, in one pass: their products
        with the changepoint's term, over what its prior allows. With double exponential priors a fit is the
        best there is if the gradient is 1 where the slope rises, −1 where it falls and between the two
        where it does not change; with normal priors it is the change itself, over its prior's width.
        """
        spec = self.spec
        by, count = list(spec.by), spec.n_changepoints
        width = 16 * (count + 2 + 2 * sum(o for _, o in spec.seasons()) + 8)
        rows = self._predict(df.where(F.col(spec.value).isNotNull()).select(*by, spec.ts, spec.value), "inner")
        wide = attach(rows, self.params, by, frozen=True, row_bytes=width)
        weight = F.lit(1.0)
        if spec.seasonality_mode == "multiplicative":
            weight = 1.0 + _dot("_terms", "_season_beta")
        wide = wide.withColumn("_terms", spec.season_terms(F.col(spec.ts)))
        wide = wide.withColumn("_hinges", spec.trend_terms(_scaled_time(spec.ts))).withColumn("_rest", (F.col(spec.value) - F.col("yhat")) / F.col("_size") * weight)
        sums = wide.groupBy(*by).agg(F.array(*[F.sum(F.col("_rest") * F.col("_hinges")[j + 2]) for j in range(count)]).cast("array<double>").alias("_sums"))
        span = F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1))
        each = attach(sums, self.params, by, frozen=True, row_bytes=width).select(
            *by, "_t0", "_size", "_sigma", span.alias("_span"),
            F.posexplode(F.arrays_zip("_sums", F.slice("_trend_beta", 3, max(count, 1)).alias("_changes"))).alias("_j", "_both"),
        )
        allowed = F.col("_sigma") * F.col("_sigma") / F.lit(spec.changepoint_prior_scale)
        place = F.lit(CHANGEPOINT_RANGE) * (F.col("_j") + 1) / F.lit(count + 1)
        return each.select(
            *by,
            F.timestamp_micros((F.col("_t0") + place * F.col("_span")).cast("long")).alias("changepoint"),
            (F.col("_both._changes") * F.col("_size") / F.col("_span") * F.lit(float(_DAY))).alias("per_day"),
            (F.col("_both._sums") / allowed).alias("gradient"),
        )

    def in_sample(self, df: DataFrame) -> DataFrame:
        """Forecast columns beside the given rows; null for a series that had no value to be fitted on."""
        return self._predict(df, "left")

    def predict(self, history: DataFrame, periods: int, freq: str = "1 day") -> DataFrame:
        """History and ``periods`` steps of ``freq`` after its last row, as ``ds, yhat, …``."""
        spec = self.spec
        by, ts = list(spec.by), spec.ts
        kind = history.schema[ts].dataType.simpleString()
        past = history.select(*by, ts)
        last = history.where(F.col(spec.value).isNotNull()).groupBy(*by).agg(F.max(ts).alias("_last"))
        step = F.expr(f"interval {freq}")
        future = last.select(
            *by,
            F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("_i") if periods > 0 else F.lit(0).alias("_i"),
            "_last",
        )
        if periods > 0:
            future = future.select(*by, (F.col("_last") + step * F.col("_i")).cast(kind).alias(ts))
            past = past.unionByName(future)
        return self._predict(past).withColumnRenamed(ts, "ds").select(*by, "ds", "yhat", "yhat_lower", "yhat_upper")

    def simulate(self, history: DataFrame, periods: int, freq: str = "1 day", draws: int = 1000, seed: int = 42) -> DataFrame:
        """The ``periods`` steps after the history, with intervals from ``draws`` simulated paths per series.

        In every step the slope changes as often, and by Laplace numbers as large, as it did in the history. Normal noise comes
        on top, the same on all steps of a path: intervals are per step, and differ then by the trend alone. All numbers come
        from hashes of seed, series, path and step.
        """
        spec = self.spec
        by, ts = list(spec.by), spec.ts
        if periods < 1 or draws < 2:
            raise ValueError("periods must be at least 1 and draws at least 2")
        last = history.where(F.col(spec.value).isNotNull()).groupBy(*by).agg(F.max(ts).alias("_last"))
        steps = last.select(*by, "_last", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("_i"))
        kind = history.schema[ts].dataType.simpleString()
        steps = steps.select(*by, "_i", *[(F.col("_last") + F.expr(f"interval {freq}") * i).cast(kind).alias(c) for c, i in ((ts, F.col("_i")), ("_previous", F.col("_i") - 1))])
        point = self._predict(steps).drop("yhat_lower", "yhat_upper")
        wide = attach(point, self.params, by, frozen=True, row_bytes=16 * (spec.n_changepoints + 64))
        # A step has a length in scaled time, and the trend a weight where the season multiplies it.
        season = _dot("_terms", "_season_beta")
        wide = wide.withColumn("_terms", spec.season_terms(F.col(ts))).select(
            *by, ts, "_i", "yhat", "_size", "_sigma", "_slope_step",
            (_scaled_time(ts) - _scaled_time("_previous")).alias("_dt"),
            (F.lit(1.0) if spec.seasonality_mode == "additive" else 1.0 + season).alias("_weight"),
            F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_d"),
        )
        side, change = (uniform(seed, stream, *by, "_d", "_i") for stream in ("side", "change"))
        radius, angle = (uniform(seed, stream, *by, "_d") for stream in ("radius", "angle"))
        laplace = -F.signum(side - 0.5) * F.ln(1.0 - 2.0 * F.abs(side - 0.5)) * F.col("_slope_step") / math.sqrt(2)
        chance = 1.0 - F.exp(-F.lit(spec.n_changepoints / CHANGEPOINT_RANGE) * F.col("_dt"))
        # As many rows as steps per window.
        so_far = Window.partitionBy(*by, "_d").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        paths = wide.withColumn("_slope", F.sum(F.when(change < chance, laplace).otherwise(0.0)).over(so_far))
        paths = paths.withColumn("_bent", F.sum(F.col("_slope") * F.col("_dt")).over(so_far))
        noise = F.sqrt(-2.0 * F.ln(radius)) * F.cos(2.0 * math.pi * angle) * F.col("_sigma")
        value = F.col("yhat") + F.col("_size") * (F.col("_bent") * F.col("_weight") + noise)
        edge = (1.0 - spec.interval_width) / 2
        out = paths.withColumn("_path", value).groupBy(*by, ts).agg(
            F.first("yhat").alias("yhat"), F.percentile("_path", F.array(F.lit(edge), F.lit(0.5), F.lit(1.0 - edge))).alias("_q")
        )
        return out.select(*by, F.col(ts).alias("ds"), "yhat", *[F.col("_q")[i].alias(c) for i, c in enumerate(("yhat_lower", "yhat_median", "yhat_upper"))])


def with_actuals(forecast: DataFrame, actuals: DataFrame, value: str = "value", by: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """Forecast rows with the observed value where there is one; without one the row is future."""
    seen = actuals.select(*by, F.col(ts).alias("ds"), value)
    return join_null_safe(forecast, seen, [*by, "ds"], how="left")
