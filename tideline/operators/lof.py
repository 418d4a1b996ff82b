"""Local outlier factor."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.operators.detector import Detector, DetectorModel, check_contamination, finish
from tideline.operators.neighbours import METRICS, nearest
from tideline.plans import attach, freeze, overlap, quantiles, rows_of, with_position
from tideline.plans.attach import join_null_safe
from tideline.plans.models import apply_models, fields, group_key, spread
from tideline.plans.settings import setting

# Factor above which "auto" calls a row anomalous; guard against zero reach.
AUTO_THRESHOLD, TINY = 1.5, 1e-10

# Rows handled at once within a block.
_SLICE = 10_000


class LocalOutlierFactor(Detector):
    """Density of a row against the density of its ``n_neighbors`` nearest rows.

    With ``novelty`` (the default) scored rows are looked up in the fitted set like any new row,
    so a row of the fitted set finds itself. Without it only the fitted rows are scored and a
    row is not its own neighbour. Equal distances are settled by value.
    """

    def __init__(
        self,
        name: str = "LOF",
        n_neighbors: int = 20,
        contamination: float | str = "auto",
        novelty: bool = True,
        metric: str = "euclidean",
        **keys: Any,
    ) -> None:
        super().__init__(name, **keys)
        check_contamination(contamination, auto=True)
        if metric == "minkowski":
            metric = "euclidean"
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}; choose from {sorted(METRICS)}")
        if n_neighbors < 1:
            raise ValueError("n_neighbors must be at least 1")
        self.n_neighbors, self.contamination = n_neighbors, contamination
        self.novelty, self.metric = novelty, metric

    def fit(self, df: DataFrame) -> DetectorModel:
        return self._fit_single(df) if self.is_single(df) else self._fit_vectors(df)

    def _thresholds(self, scores: DataFrame, weight: str | None) -> DataFrame | None:
        if self.contamination == "auto":
            return None
        cut = quantiles(scores, self.by, "_lof", {"_cut": 1 - self.contamination}, weight)
        return freeze(cut, "threshold")

    # One number per row: in value order the nearest rows lie within k distinct values on either
    # side, and a row's factor depends on its value only. So the work is done on distinct values,
    # in blocks of the value order that overlap by the 3k values a factor depends on.

    def _fit_single(self, df: DataFrame) -> SingleLofModel:
        by, k = self.by, self.n_neighbors
        value = F.col(self.inputs[0]).cast("double")
        counts = df.where(value.isNotNull()).groupBy(*by, value.alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
        counts = freeze(counts, "values")
        totals = counts.groupBy(*by).agg(F.least(F.sum("_m") - 1, F.lit(k)).alias("_k"))
        placed = attach(with_position(counts, by, ["_v"], "_pos"), totals, by)
        block = max(setting(df.sparkSession, "valueBlock"), 4 * k)
        rows = overlap(placed, "_pos", block, 3 * k, 3 * k).withColumn("_g", group_key(by))

        def factors(block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values("_v").reset_index(drop=True)
            own = np.flatnonzero(block["_copy"] == 0)
            v, m, wanted = block["_v"].to_numpy(), block["_m"].to_numpy(), int(block["_k"].iloc[0])
            kdist, lrd, lof = fitted_factors(v, m, k, wanted)
            out = block[[*by, "_block", "_v", "_m", "_k"]].assign(_own=block["_copy"] == 0, _kdist=kdist, _lrd=lrd, _lof=lof)
            # With the k values on either side a block answers for every value from its first to the next one's.
            return out.iloc[max(0, own[0] - k) : own[-1] + 1 + k] if len(own) else out.head(0)

        schema = f"{fields(rows, [*by, '_block', '_v', '_m', '_k'])}, _own boolean, _kdist double, _lrd double, _lof double"
        blocks = spread(rows, "_g", "_block").groupBy("_g", "_block").applyInPandas(factors, schema)
        blocks = freeze(blocks.withColumn("_part", _part(df.sparkSession, by)), "blocks", ["_part"])
        edges = freeze(blocks.where("_own").groupBy(*by, "_block").agg(F.min("_v").alias("_first")), "edges")
        return SingleLofModel(self.name, self, blocks, edges, self._thresholds(blocks.where("_own"), "_m"))

    # Vectors: again a factor depends on the vector only, so copies are counted and distinct
    # vectors compared. Equal distances are settled by the order of the vectors.

    def _fit_vectors(self, df: DataFrame) -> VectorLofModel:
        by, k = self.by, self.n_neighbors
        whole = df.select(*by, self.vector(df).alias("_x")).where(F.col("_x").isNotNull())
        counts = freeze(whole.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_m")), "counts")
        known = freeze(with_position(counts, by, ["_x"], "_vid"), "vectors")
        totals = known.groupBy(*by).agg(F.least(F.sum("_m") - 1, F.lit(k)).alias("_k"))
        totals = freeze(totals, "totals")
        # One more than k, because a vector finds itself.
        near = nearest(known, known, by, k + 1, self.metric)
        pairs = freeze(_taken(attach(near, totals, by, frozen=True), by, own=1), "pairs")
        size = rows_of(known)
        facts = freeze(_reach_densities(pairs, by, size), "densities")
        mean = _mean_densities(pairs, facts, by, size)
        scores = join_null_safe(mean, facts, [*by, "_vid"])
        scores = scores.select(*by, "_vid", (F.col("_mean") / F.col("_lrd")).alias("_lof"))
        # A lone row has no neighbours and a factor of 1.
        scored = join_null_safe(known, scores, [*by, "_vid"], how="left")
        scored = freeze(scored.select(*by, "_x", "_m", F.coalesce("_lof", F.lit(1.0)).alias("_lof")), "lof")
        return VectorLofModel(self.name, self, known, totals, facts, scored, self._thresholds(scored, "_m"))


def _closest(v: np.ndarray, m: np.ndarray, places: np.ndarray, q: np.ndarray, wanted: int) -> tuple[np.ndarray, ...]:
    """Candidates of each ``q`` from near to far: place, distance and how many rows of it count.

    ``places`` index the sorted values ``v`` in rising order, so equal distances go to the smaller
    value. ``m`` is how often each candidate occurs.
    """
    inside = (places >= 0) & (places < len(v))
    at = np.clip(places, 0, len(v) - 1)
    d = np.where(inside, np.abs(v[at] - q[:, None]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    at, d = np.take_along_axis(at, order, axis=1), np.take_along_axis(d, order, axis=1)
    m = np.where(np.isfinite(d), np.take_along_axis(m, order, axis=1), 0)
    taken = np.clip(wanted - (np.cumsum(m, axis=1) - m), 0, m)
    return at, np.where(np.isfinite(d), d, 0.0), taken


def _density(reach: np.ndarray, taken: np.ndarray, wanted: int) -> np.ndarray:
    return 1.0 / ((reach * taken).sum(axis=1) / wanted + TINY)


def _slices(n: int) -> Iterator[slice]:
    return (slice(s, s + _SLICE) for s in range(0, n, _SLICE))


def fitted_factors(v: np.ndarray, m: np.ndarray, k: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-distance, reachability density and factor of sorted distinct values occurring ``m`` times."""
    n = len(v)
    kdist, lrd, lof = np.zeros(n), np.full(n, np.nan), np.ones(n)
    if wanted < 1:
        return kdist, lrd, lof

    def around(part: slice) -> tuple[np.ndarray, ...]:
        rows = np.arange(n)[part]
        places = rows[:, None] + np.arange(-k, k + 1)[None, :]
        times = m[np.clip(places, 0, n - 1)] - (places == rows[:, None])
        return _closest(v, times, places, v[part], wanted)

    for part in _slices(n):
        _, d, taken = around(part)
        kdist[part] = (d * (taken > 0)).max(axis=1)
    for part in _slices(n):
        at, d, taken = around(part)
        lrd[part] = _density(np.maximum(d, kdist[at]), taken, wanted)
    for part in _slices(n):
        at, _, taken = around(part)
        lof[part] = (lrd[at] * taken).sum(axis=1) / wanted / lrd[part]
    return kdist, lrd, lof


def new_factors(
    v: np.ndarray, m: np.ndarray, kdist: np.ndarray, lrd: np.ndarray, q: np.ndarray, k: int, wanted: int
) -> np.ndarray:
    """Factors of values ``q`` against the fitted ones."""
    out = np.ones(len(q))
    if wanted < 1:
        return out
    for part in _slices(len(q)):
        places = np.searchsorted(v, q[part], side="right")[:, None] + np.arange(-k, k)[None, :]
        at, d, taken = _closest(v, m[np.clip(places, 0, len(v) - 1)], places, q[part], wanted)
        own = _density(np.maximum(d, kdist[at]), taken, wanted)
        out[part] = (lrd[at] * taken).sum(axis=1) / wanted / own
    return out


def _part(spark: SparkSession, by: Sequence[str]) -> Column:
    """The folder of a block."""
    return F.pmod(F.xxhash64(*by, "_block"), F.lit(setting(spark, "valueParts"))).cast("int")


def _block_of(x: np.ndarray, model: dict[str, Any]) -> np.ndarray:
    """The block that answers for each value: the last one that begins at or before it, else the first."""
    order = np.argsort(model["_first"])
    at = np.searchsorted(np.asarray(model["_first"])[order], x[:, 0], side="right") - 1
    return np.asarray(model["_block"], dtype=np.float64)[order][np.maximum(at, 0)]


@dataclass(frozen=True)
class SingleLofModel(DetectorModel):
    """``blocks``: runs of fitted values in order, each with its surroundings; ``edges``: where they begin."""

    name: str
    spec: LocalOutlierFactor
    blocks: DataFrame
    edges: DataFrame
    thresholds: DataFrame | None

    def transform(self, df: DataFrame) -> DataFrame:
        spec = self.spec
        by = spec.by
        value = F.col(spec.inputs[0]).cast("double")
        rows = df.withColumn("_v", value)
        if spec.novelty:
            factors = self._look_up(rows.where(F.col("_v").isNotNull()).select(*by, "_v").distinct())
        else:
            factors = self.blocks.where("_own").select(*by, "_v", F.col("_lof").alias("_raw"))
        out = attach(rows, factors, [*by, "_v"], how="left", row_bytes=64).drop("_v")
        return finish(_with_threshold(out, self.thresholds, by), centred=False)

    def _look_up(self, asked: DataFrame) -> DataFrame:
        """Factors of distinct values. Only the asked values are written, and only the folders of their
        blocks are read."""
        spark, by, k = asked.sparkSession, self.spec.by, self.spec.n_neighbors
        placed = apply_models(asked.withColumn("_x", F.array("_v")), by, "_x", self.edges, _block_of, "_block", 64)
        # Without a block there is no fitted series, and no factor.
        own = freeze(placed.where(F.col("_block").isNotNull()).select(*by, "_v", F.col("_block").cast("long").alias("_block")), "asked")
        # However many ask in one block, a task gets a bounded share of them and the block's fitted values.
        most = F.lit(setting(spark, "askedRows"))
        shares = own.groupBy(*by, "_block").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_shares"))
        shares = freeze(shares.withColumn("_part", _part(spark, by)), "shares")
        # At most as many numbers as there are folders.
        hit = [r["_part"] for r in shares.select("_part").distinct().collect()]
        known = self.blocks.where(F.col("_part").isin(hit)).select(*by, "_block", "_v", "_m", "_k", "_kdist", "_lrd", F.lit(0).alias("_kind"))
        shares = shares.drop("_part")
        spread_own = attach(own, shares, [*by, "_block"], frozen=True, row_bytes=64).withColumn("_share", F.pmod(F.xxhash64("_v"), F.col("_shares")).cast("int"))
        repeated = attach(known, shares, [*by, "_block"], frozen=True, row_bytes=64).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
        rows = repeated.unionByName(spread_own.withColumn("_kind", F.lit(1)), allowMissingColumns=True).drop("_shares").withColumn("_g", group_key(by))

        def factors(rows: pd.DataFrame) -> pd.DataFrame:
            fit, new = rows[rows["_kind"] == 0].sort_values("_v"), rows[rows["_kind"] == 1]
            arrays = [fit[c].to_numpy() for c in ("_v", "_m", "_kdist", "_lrd")]
            wanted = int(fit["_k"].iloc[0])
            return new[[*by, "_v"]].assign(_raw=new_factors(*arrays, new["_v"].to_numpy(), k, wanted))

        schema = f"{fields(asked, [*by, '_v'])}, _raw double"
        return spread(rows, "_g", "_block", "_share").groupBy("_g", "_block", "_share").applyInPandas(factors, schema)


def _with_threshold(df: DataFrame, thresholds: DataFrame | None, by: Sequence[str]) -> DataFrame:
    if thresholds is None:
        return df.withColumn("_cut", F.lit(AUTO_THRESHOLD))
    return attach(df, thresholds, by, how="left", frozen=True)


def _taken(near: DataFrame, by: Sequence[str], own: int) -> DataFrame:
    """Neighbours and how many rows of each count towards ``_k``: ``(by, _qid, _nbr, _dist, _t)``."""
    copies = F.transform("_near", lambda c: F.struct(c["d"].alias("d"), c["vid"].alias("vid"), F.when(c["vid"] == F.col("_qid"), c["m"] - own).otherwise(c["m"]).alias("m")))
    start = F.struct(
        F.lit(0).cast("long").alias("got"), F.array().cast("array<struct<d:double,vid:bigint,t:bigint>>").alias("out")
    )

    def step(acc: Column, c: Column) -> Column:
        t = F.least(c["m"], F.col("_k") - acc["got"])
        more = F.concat(acc["out"], F.array(F.struct(c["d"].alias("d"), c["vid"].alias("vid"), t.alias("t"))))
        return F.struct((acc["got"] + t).alias("got"), F.when(t > 0, more).otherwise(acc["out"]).alias("out"))

    taken = F.aggregate(copies, start, step)["out"]
    rows = near.select(*by, "_qid", F.explode(taken).alias("_c"))
    return rows.select(
        *by, "_qid", F.col("_c.vid").alias("_nbr"), F.col("_c.d").alias("_dist"), F.col("_c.t").alias("_t")
    )


def _mean_of(c: Column) -> Column:
    return F.sum(c * F.col("_t")) / F.sum("_t")


def _reach_densities(pairs: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """``(by, _vid, _kdist, _lrd)`` of the fitted vectors."""
    kdist = pairs.groupBy(*by, F.col("_qid").alias("_vid")).agg(F.max("_dist").alias("_kdist"))
    of_neighbour = kdist.select(*by, F.col("_vid").alias("_nbr"), F.col("_kdist").alias("_reach"))
    joined = attach(pairs, of_neighbour, [*by, "_nbr"], at_most=size)
    lrd = joined.groupBy(*by, F.col("_qid").alias("_vid")).agg(
        (1.0 / (_mean_of(F.greatest("_dist", "_reach")) + F.lit(TINY))).alias("_lrd")
    )
    return join_null_safe(kdist, lrd, [*by, "_vid"])


def _mean_densities(pairs: DataFrame, facts: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    of_neighbour = facts.select(*by, F.col("_vid").alias("_nbr"), F.col("_lrd").alias("_near"))
    joined = attach(pairs, of_neighbour, [*by, "_nbr"], at_most=size)
    return joined.groupBy(*by, F.col("_qid").alias("_vid")).agg(_mean_of(F.col("_near")).alias("_mean"))


@dataclass(frozen=True)
class VectorLofModel(DetectorModel):
    name: str
    spec: LocalOutlierFactor
    known: DataFrame
    totals: DataFrame
    facts: DataFrame
    scores: DataFrame
    thresholds: DataFrame | None

    def transform(self, df: DataFrame) -> DataFrame:
        spec = self.spec
        by = spec.by
        rows = df.withColumn("_x", spec.vector(df))
        if spec.novelty:
            factors = self._look_up(rows.where(F.col("_x").isNotNull()).select(*by, "_x").distinct())
        else:
            factors = self.scores.select(*by, "_x", F.col("_lof").alias("_raw"))
        out = attach(rows, factors, [*by, "_x"], how="left", row_bytes=1024, repeated=False).drop("_x")
        return finish(_with_threshold(out, self.thresholds, by), centred=False)

    def _look_up(self, vectors: DataFrame) -> DataFrame:
        spec = self.spec
        by = spec.by
        asked = freeze(with_position(freeze(vectors, "distinct"), by, ["_x"], "_vid"), "asked")
        near = nearest(asked, self.known, by, spec.n_neighbors, spec.metric)
        pairs = _taken(attach(near, self.totals, by, frozen=True), by, own=0)
        facts = self.facts.select(*by, F.col("_vid").alias("_nbr"), "_kdist", "_lrd")
        joined = attach(pairs, facts, [*by, "_nbr"], at_most=rows_of(self.facts))
        own = 1.0 / (_mean_of(F.greatest("_dist", "_kdist")) + F.lit(TINY))
        factors = joined.groupBy(*by, "_qid").agg((_mean_of(F.col("_lrd")) / own).alias("_raw"))
        out = join_null_safe(asked, factors.withColumnRenamed("_qid", "_vid"), [*by, "_vid"], how="left")
        return out.select(*by, "_x", F.coalesce("_raw", F.lit(1.0)).alias("_raw"))
