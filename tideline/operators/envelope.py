"""Elliptic envelope: squared robust distance from the bulk of the rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, functions as F

from tideline.functions.chi2 import chi2_quantile
from tideline.operators.detector import Detector, DetectorModel, check_contamination, finish
from tideline.plans import LastSeen, Running, attach, freeze, quantiles, rows_of, scan, smallest
from tideline.plans.models import apply_models, fields, group_key, matrix, sample_rate, uniform
from tideline.plans.moments import outer_sums


# Rows about the border of a support that one task concentrates, in bytes.
_BAND_BYTES = 16 * 1024 * 1024


class EllipticEnvelope(Detector):
    """Minimum covariance determinant estimate, corrected and reweighted once.

    The threshold is the quantile of the training distances that leaves ``contamination`` above.
    A series of equal rows has no estimate and gets no verdict. Where over half of the numbers are
    equal, the mean square around them takes the place of the median square.

    Vectors: ``starts`` random starts are concentrated on a sample of ``start_rows`` rows of the
    series; the best of them goes through concentration steps over all rows, each on exactly the
    support's size, until the determinant of every series has settled. In long series only a few rows
    about the border change sides in a late step, for more steps the more rows there are; so from half
    of ``max_steps`` on those rows settle among themselves before each step over all rows. Should it
    take more than ``max_steps`` steps, fitting raises rather than return an estimate that has not.
    """

    def __init__(
        self,
        name: str = "EllipticEnvelope",
        contamination: float = 0.1,
        support_fraction: float | None = None,
        seed: int = 42,
        start_rows: int = 1500,
        starts: int = 100,
        max_steps: int = 100,
        **keys: Any,
    ) -> None:
        super().__init__(name, **keys)
        check_contamination(contamination, auto=False)
        self.start_rows, self.starts, self.max_steps = start_rows, starts, max_steps
        if support_fraction is not None and not 0 < support_fraction <= 1:
            raise ValueError("support_fraction must be in (0, 1]")
        self.contamination, self.support_fraction, self.seed = contamination, support_fraction, seed

    def support(self, n: Column, p: int) -> Column:
        wanted = F.ceil((n + F.lit(p + 1)) / 2) if self.support_fraction is None else F.floor(n * F.lit(self.support_fraction))
        return F.greatest(F.least(wanted, n), F.lit(1))

    def fit(self, df: DataFrame) -> EnvelopeModel:
        return self._fit_single(df) if self.is_single(df) else self._fit_vectors(df)

    # One number per row: everything depends on the distinct values and how often they occur.

    def _fit_single(self, df: DataFrame) -> SingleEnvelopeModel:
        by, v, m = self.by, F.col("_v"), F.col("_m")
        value = F.col(self.inputs[0]).cast("double")
        counts = df.where(value.isNotNull()).groupBy(*by, value.alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
        counts = freeze(counts, "values")
        size = rows_of(counts)
        totals = counts.groupBy(*by).agg(F.sum("_m").alias("_n"), (F.sum(v * m) / F.sum("_m")).alias("_mean"))
        totals = freeze(totals.withColumn("_h", F.least(self.support(F.col("_n"), 1), F.col("_n"))), "totals")
        groups = rows_of(totals)
        # The variance of the support would cancel below: only squares around the location count.
        placed = attach(counts, self._locate(counts, totals), by, at_most=groups)
        c = v - F.col("_loc")
        squares = placed.withColumn("_d2", c * c)
        median = quantiles(squares, by, "_d2", {"_median": 0.5}, "_m", size)
        # Where half of the values are equal the median is 0, and the mean square stands in for it.
        mean = squares.groupBy(*by).agg((F.sum(m * F.col("_d2")) / F.sum(m)).alias("_mean_square"))
        scales = attach(median, mean, by, "left", at_most=groups).select(
            *by, F.when(F.col("_median") > 0, F.col("_median") / F.lit(chi2_quantile(0.5, 1))).otherwise(F.col("_mean_square")).alias("_scale")
        )
        spread = attach(squares, scales, by, at_most=groups)
        inside = spread.where(F.try_divide(F.col("_d2"), F.col("_scale")) < F.lit(chi2_quantile(0.975, 1)))
        kept_variance = F.sum(m * c * c) / F.sum(m) - F.pow(F.sum(m * c) / F.sum(m), 2)
        final = inside.groupBy(*by, "_loc", "_scale").agg(
            (F.first("_loc") + F.sum(m * c) / F.sum(m)).alias("_location"), kept_variance.alias("_kept")
        )
        # If only equal values are kept, the scale they were chosen by is the variance.
        variance = F.when(F.col("_kept") > 0, F.col("_kept")).otherwise(F.col("_scale")).alias("_variance")
        final = freeze(final.select(*by, "_location", variance), "location")
        last = attach(counts, final, by, frozen=True).withColumn(
            "_dist", _distance(v, F.col("_location"), F.col("_variance"))
        )
        cut = quantiles(last, by, "_dist", {"_cut": 1 - self.contamination}, "_m", size)
        return SingleEnvelopeModel(self.name, self, freeze(attach(final, cut, by, at_most=groups), "envelope"))

    def _locate(self, counts: DataFrame, totals: DataFrame) -> DataFrame:
        """Middle of the shortest stretch holding the support, averaged over ties."""
        by, v, u = self.by, F.col("_v"), F.col("_far")["u"]
        size = rows_of(counts)
        ranked = scan(attach(counts, totals, by, frozen=True), by, ["_v"], [Running(F.col("_m"), "_hi")], size)
        ranked = ranked.withColumn("_lo", F.col("_hi") - F.col("_m"))
        # Each value stands at its first rank and asks for the value h ranks further on, which is
        # the last one standing at or before that rank.
        own = F.struct(F.col("_lo").alias("_rank"), F.lit(0).alias("_kind"))
        further = F.struct((F.col("_lo") + F.col("_h")).alias("_rank"), F.lit(1).alias("_kind"))
        places = F.array_compact(F.array(own, F.when(further["_rank"] < F.col("_n"), further)))
        asked = ranked.select(*by, "_v", "_hi", "_lo", "_h", F.explode(places).alias("_place"))
        asked = asked.select(*by, "_v", "_hi", "_lo", "_h", "_place.*")
        at_rank = F.when(F.col("_kind") == 0, F.struct(v.alias("u"), F.col("_hi").alias("hi")))
        pairs = scan(asked, by, ["_rank", "_kind"], [LastSeen(at_rank, "_far")], 2 * size).where("_kind = 1")
        ties = F.least(F.col("_hi"), F.col("_far")["hi"] - F.col("_h")) - F.col("_lo")
        lengths = pairs.groupBy(*by, (u - v).alias("_len")).agg(
            F.sum(ties).alias("w"), F.sum(ties * (u + v) / 2).alias("s")
        )
        best = lengths.groupBy(*by).agg(F.min_by(F.col("s") / F.col("w"), "_len").alias("_mid"))
        both = attach(totals, best, by, how="left", at_most=rows_of(totals))
        # With all rows in the support the location is their mean.
        return both.select(*by, F.coalesce("_mid", "_mean").alias("_loc"), "_h")

    # Vectors: several starts on a sample, then concentration steps over all rows.

    def _fit_vectors(self, df: DataFrame) -> VectorEnvelopeModel:
        by = self.by
        rows = df.select(*by, *self.order, self.vector(df).alias("_x")).where(F.col("_x").isNotNull())
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("_x")).alias("_p"))
        sizes = freeze(sizes, "sizes")
        p, longest, average = sizes.agg(F.max("_p"), F.max("_n"), F.avg("_n")).first()
        if p is None:
            raise ValueError("no complete rows to fit on")
        sizes = freeze(sizes.withColumn("_h", self.support(F.col("_n"), p)), "sizes")
        model = freeze(self._start(rows, sizes, p), "start")
        # A step never raises a determinant, so each series settles; the ones that have keep their estimate.
        for turn in range(self.max_steps):
            if turn >= self.max_steps // 2:
                model = freeze(self._narrowed(rows, model, sizes, p, longest, average), "narrowed")
            before, change = model.select(*by, F.col("log_det").alias("_before")), Observation()
            step = attach(self._refit(rows, model, sizes, p, longest, average), before, by, row_bytes=32, at_most=rows_of(model))
            moved = F.abs(F.col("log_det") - F.col("_before")) / F.greatest(F.lit(1.0), F.abs("_before"))
            model = freeze(step.observe(change, F.max(moved).alias("m")).drop("_before"), "shape")
            if (change.get["m"] or 0.0) <= 1e-9:
                break
        else:
            raise RuntimeError(f"the support has not settled in {self.max_steps} steps; raise max_steps")
        scored = freeze(self._distances(rows, model, p).select(*by, "_x", "_dist"), "distances")
        groups = rows_of(sizes)
        median = quantiles(scored, by, "_dist", {"_median": 0.5})
        corrected = F.try_divide(F.col("_dist") * F.lit(chi2_quantile(0.5, p)), F.col("_median"))
        kept = attach(scored, median, by, at_most=groups).where(corrected < F.lit(chi2_quantile(0.975, p)))
        model = freeze(self._shape(kept, p, average), "shape")
        last = freeze(self._distances(rows, model, p).select(*by, "_dist"), "distances")
        cut = freeze(quantiles(last, by, "_dist", {"_cut": 1 - self.contamination}), "threshold")
        return VectorEnvelopeModel(self.name, self, model, cut, p)

    def _distances(self, rows: DataFrame, model: DataFrame, p: int) -> DataFrame:
        return apply_models(rows, self.by, "_x", model, mahalanobis, "_dist", 8 * p * (p + 1) + 64)

    def _refit(self, rows: DataFrame, model: DataFrame, sizes: DataFrame, p: int, longest: int, average: float) -> DataFrame:
        """One concentration step: the closest rows, exactly as many as the support has, give the next shape."""
        by = self.by
        kept = smallest(self._distances(rows, model, p), by, "_dist", self.order, sizes, "_h", longest)
        return self._shape(kept, p, average)

    def _narrowed(self, rows: DataFrame, model: DataFrame, sizes: DataFrame, p: int, longest: int, average: float) -> DataFrame:
        """Shapes after concentration steps among the rows about the border of the support, in one task per series.

        Rows well within the support stay there and count by their sums, rows well outside stay out, so the
        determinant falls as it does in steps over all rows; only such a step can tell that it has settled. A series
        with too many equal distances for a task keeps its shape.
        """
        by, d = self.by, F.col("_dist")
        band = max(1, _BAND_BYTES // (16 * (p + 1)))
        scored = freeze(self._distances(rows, model, p).select(*by, *self.order, "_x", "_dist"), "distances")
        edges = sizes.select(*by, F.greatest(F.col("_h") - band, F.lit(0)).alias("_few"), (F.col("_h") + band).alias("_many"), "_h")
        edges, groups = freeze(edges, "edges"), rows_of(sizes)
        narrow = scored.select(*by, *self.order, "_dist")
        ends = [smallest(narrow, by, "_dist", self.order, edges, c, longest).groupBy(*by).agg(F.max("_dist").alias(f"_at{c}")) for c in ("_few", "_many")]
        cuts = edges.select(*by, "_h")
        for end in ends:
            cuts = attach(cuts, end, by, "left", at_most=groups)
        # A series no longer than the band has no row that is sure to stay.
        low = F.coalesce("_at_few", F.lit(float("-inf")))
        cut = attach(scored, freeze(cuts, "cuts"), by, frozen=True)
        inside, border = d < low, d.between(low, F.col("_at_many"))
        facts = cut.groupBy(*by, "_h").agg(F.count_if(inside).alias("_in"), F.count_if(border).alias("_border"))
        facts = freeze(facts.select(*by, (F.col("_h") - F.col("_in")).alias("_want"), "_border"), "facts")
        sums = outer_sums(_with_one(cut.where(inside), by), by, "_z", average)
        entries = F.transform(F.array_sort(F.collect_list(F.struct("i", "total"))), lambda e: e["total"])
        # Where no row is sure to stay there are no sums; without series that is an empty list, not a missing row.
        fixed = sums.groupBy(*by).agg(entries.alias("_sums")).where(F.size("_sums") > 0)
        known = attach(attach(model, facts, by, "left", frozen=True), fixed, by, "left", at_most=groups, row_bytes=8 * (p + 1) ** 2)
        known = known.withColumn("_g", group_key(by))
        near = attach(cut.where(border), facts.where(F.col("_border") <= 4 * band), by, at_most=groups)
        near = near.select(group_key(by).alias("_g"), "_x")

        def settle(some: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
            shapes = [*by, "location", "precision", "log_det"]
            now = one[shapes].reset_index(drop=True)
            if not len(some):
                return now
            x, want = matrix(some["_x"]), int(one["_want"].iloc[0])
            z = np.column_stack([np.ones(len(x)), x])
            held = one["_sums"].iloc[0]
            within = np.zeros((p + 1, p + 1)) if held is None else np.asarray(held).reshape(p + 1, p + 1)
            while True:
                closest = z[np.argsort(mahalanobis(x, {c: now[c].to_list() for c in ("location", "precision")}), kind="stable")[:want]]
                after = _shape_row(now[by], *_moments(within + closest.T @ closest))
                before, then = float(now["log_det"].iloc[0]), float(after["log_det"].iloc[0])
                if not before - then > 1e-12 * max(1.0, abs(before)):
                    return now[shapes]
                now = after

        return near.groupBy("_g").cogroup(known.groupBy("_g")).applyInPandas(settle, _shape_schema(rows, by))

    def _shape(self, kept: DataFrame, p: int, average: float) -> DataFrame:
        return solve_shape(outer_sums(_with_one(kept, self.by), self.by, "_z", average), self.by, p)

    def _start(self, rows: DataFrame, sizes: DataFrame, p: int) -> DataFrame:
        by, seed, wanted, starts = self.by, self.seed, self.start_rows, self.starts
        keys = [*by, *self.order]
        draw = uniform(seed, "start", *keys)
        sample = (
            attach(rows, sizes, by, frozen=True)
            .where(draw < sample_rate(wanted, F.col("_n")))
            .select(group_key(by).alias("_g"), *by, draw.alias("_draw"), (F.col("_h") / F.col("_n")).alias("_share"), "_x")
        )

        def search(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("_draw").head(wanted)
            location, cov = best_start(matrix(group["_x"]), float(group["_share"].iloc[0]), np.random.default_rng(seed), starts)
            first = group.head(1)[by].copy()
            return _shape_row(first, location, cov)

        return sample.groupBy("_g").applyInPandas(search, _shape_schema(rows, by))


def _distance(v: Column, location: Column, variance: Column) -> Column:
    """Squared distance in units of the variance; null where there is no spread."""
    return F.try_divide(F.pow(v - location, 2), variance)


def _with_one(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.select(*by, F.concat(F.array(F.lit(1.0)), F.col("_x")).alias("_z"))


def _moments(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from the summed outer products of (1, x)."""
    location = m[0, 1:] / m[0, 0]
    return location, m[1:, 1:] / m[0, 0] - np.outer(location, location)


def _shape_schema(rows: DataFrame, by: list[str]) -> str:
    parts = ["location array<double>", "precision array<double>", "log_det double"]
    return ", ".join([*([fields(rows, by)] if by else []), *parts])


def _shape_row(first: pd.DataFrame, location: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    values = np.maximum(np.linalg.eigvalsh(cov), 1e-300)
    precision = np.linalg.pinv(cov, hermitian=True)
    if not len(first.columns):
        first = pd.DataFrame(index=[0])
    return first.assign(location=[location.tolist()], precision=[precision.ravel().tolist()], log_det=[float(np.log(values).sum())])


def solve_shape(sums: DataFrame, by: list[str], p: int) -> DataFrame:
    """Location, inverse covariance and log determinant from the summed outer products of (1, x)."""
    keyed = sums.withColumn("_g", group_key(by))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        flat = np.zeros((p + 1) ** 2)
        flat[group["i"].to_numpy()] = group["total"].to_numpy()
        return _shape_row(group.head(1)[by].reset_index(drop=True), *_moments(flat.reshape(p + 1, p + 1)))

    return keyed.groupBy("_g").applyInPandas(solve, _shape_schema(sums, by))


def mahalanobis(x: np.ndarray, model: dict[str, Any]) -> np.ndarray:
    location = np.asarray(model["location"][0])
    precision = np.asarray(model["precision"][0]).reshape(len(location), -1)
    c = x - location
    return np.maximum(((c @ precision) * c).sum(axis=1), 0.0)


def best_start(x: np.ndarray, share: float, rng: np.random.Generator, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Best of several concentrated random starts on a sample small enough for one task."""
    n, p = x.shape
    h = min(n, max(1, int(np.ceil(share * n))))

    def shape(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return part.mean(axis=0), np.atleast_2d(np.cov(part, rowvar=False, bias=True))

    def concentrate(location: np.ndarray, cov: np.ndarray, steps: int | None) -> tuple[float, np.ndarray, np.ndarray]:
        before = np.inf
        # The determinant falls with every step, so this ends even without a number of steps.
        for _ in range(steps) if steps else iter(int, 1):
            c = x - location
            d = ((c @ np.linalg.pinv(cov, hermitian=True)) * c).sum(axis=1)
            location, cov = shape(x[np.argsort(d, kind="stable")[:h]])
            sign, log_det = np.linalg.slogdet(cov)
            now = log_det if sign > 0 else -np.inf
            if now >= before or now == -np.inf:
                break
            before = now
        return now, location, cov

    if h >= n:
        return shape(x)
    tries = []
    for _ in range(starts):
        tries.append(concentrate(*shape(x[rng.choice(n, size=min(n, p + 1), replace=False)]), steps=2))
    tries.sort(key=lambda t: t[0])
    final = min((concentrate(loc, cov, None) for _, loc, cov in tries[: max(1, starts // 10)]), key=lambda t: t[0])
    return final[1], final[2]


class EnvelopeModel(DetectorModel):
    pass


@dataclass(frozen=True)
class SingleEnvelopeModel(EnvelopeModel):
    name: str
    spec: EllipticEnvelope
    params: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        joined = attach(df, self.params, self.spec.by, how="left", frozen=True)
        value = F.col(self.spec.inputs[0]).cast("double")
        raw = F.when(value.isNotNull(), _distance(value, F.col("_location"), F.col("_variance")))
        return finish(joined.withColumn("_raw", raw).drop("_location", "_variance"), centred=True)


@dataclass(frozen=True)
class VectorEnvelopeModel(EnvelopeModel):
    name: str
    spec: EllipticEnvelope
    shapes: DataFrame
    thresholds: DataFrame
    p: int

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("_x", self.spec.vector(df))
        scored = self.spec._distances(rows, self.shapes, self.p).withColumnRenamed("_dist", "_raw").drop("_x")
        return finish(attach(scored, self.thresholds, self.spec.by, how="left", frozen=True), centred=True)
