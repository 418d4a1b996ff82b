"""Isolation forest."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tideline.operators.detector import Detector, DetectorModel, check_contamination, finish
from tideline.plans import attach, freeze, quantiles
from tideline.plans.models import apply_models, fields, group_key, matrix, sample_rate, spread, uniform

# Fixed value: the score above which "auto" calls a row anomalous.
AUTO_THRESHOLD = 0.5


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average depth of an unsuccessful search in a binary tree of n leaves."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


class IsolationForest(Detector):
    """Rows that random cuts separate early are anomalous.

    Every tree is grown from a sample of at most ``max_samples`` rows of the series, drawn by hashing
    the row's keys: the forest is the same however the rows are partitioned.
    """

    def __init__(
        self,
        name: str = "IsolationForest",
        n_estimators: int = 100,
        contamination: float | str = "auto",
        max_features: float = 1.0,
        max_samples: int = 256,
        seed: int = 42,
        **keys: Any,
    ) -> None:
        super().__init__(name, **keys)
        check_contamination(contamination, auto=True)
        self.n_estimators, self.contamination = n_estimators, contamination
        if max_samples < 1:
            raise ValueError("max_samples must be at least 1")
        self.max_features, self.max_samples, self.seed = max_features, max_samples, seed

    def fit(self, df: DataFrame) -> IsolationForestModel:
        rows = df.select(*self.by, *self.order, self.vector(df).alias("_x")).where(F.col("_x").isNotNull())
        sizes = freeze(rows.groupBy(*self.by).agg(F.count(F.lit(1)).alias("_n")), "sizes")
        trees = freeze(self._grow(rows, sizes, self.is_single(df)), "forest")
        model = IsolationForestModel(self.name, self, trees, None)
        if self.contamination == "auto":
            return model
        scored = freeze(model.raw(df).where(F.col("_raw").isNotNull()).select(*self.by, "_raw"), "scores")
        cut = quantiles(scored, self.by, "_raw", {"_cut": 1 - self.contamination})
        return IsolationForestModel(self.name, self, trees, freeze(cut, "threshold"))

    def _grow(self, rows: DataFrame, sizes: DataFrame, single: bool) -> DataFrame:
        """One row per series and tree, or per series its steps where a row is a single number."""
        t, seed, share, wanted = self.n_estimators, self.seed, self.max_features, self.max_samples
        keys = [*self.by, *self.order]
        # One hash per row leaves a pool large enough for all trees; trees draw from the pool.
        pool_rate = sample_rate(t * wanted, F.col("_n"))
        pool = attach(rows, sizes, self.by, frozen=True).where(uniform(seed, "pool", *keys) < pool_rate)
        pool = pool.withColumn("_row", F.xxhash64(F.lit(seed), *keys))
        tree_rate = F.least(F.lit(1.0), sample_rate(wanted, F.col("_n") * pool_rate))

        def draw(tree: Column) -> Column:
            return F.xxhash64("_row", tree)

        # Draws spread evenly over the longs, so the rate is a cut among them.
        cut = (F.lit(-(2.0**63)) + F.lit(2.0**64) * tree_rate).cast("double")
        drawn = F.filter(F.sequence(F.lit(0), F.lit(t - 1)), lambda k: draw(k) < F.col("_cut"))
        members = pool.withColumn("_cut", cut).withColumn("_tree", F.explode(drawn)).select(
            group_key(self.by).alias("_g"),
            *self.by,
            "_tree",
            draw(F.col("_tree")).alias("_draw"),
            F.xxhash64(*self.by, "_tree").alias("_salt"),
            "_x",
        )

        def build(group: pd.DataFrame) -> pd.DataFrame:
            first = group.head(1)[[*by]].reset_index(drop=True) if by else pd.DataFrame(index=[0])
            trees = []
            for k, part in group.groupby("_tree", sort=True):
                part = part.sort_values("_draw").head(wanted)
                rng = np.random.default_rng([seed, int(k), int(part["_salt"].iloc[0]) % 2**63])
                trees.append(grow_tree(matrix(part["_x"]), rng, share))
            if single:
                edges, scores = forest_steps({name: [t[name] for t in trees] for name in trees[0]})
                return first.assign(edges=[edges.tolist()], scores=[scores.tolist()])
            return pd.concat([first.assign(_tree=k, **{name: [v] for name, v in t.items()}) for k, t in enumerate(trees)], ignore_index=True)

        by = list(self.by)
        kinds = ["edges array<double>, scores array<double>"] if single else ["_tree int, feature array<int>, cut array<double>, left array<int>, path array<double>, sample int"]
        schema = ", ".join([*([fields(members, by)] if by else []), *kinds])
        # The pool of a series is bounded by the size of its forest, however long the series is.
        return spread(members, "_g").groupBy("_g").applyInPandas(build, schema)


def grow_tree(x: np.ndarray, rng: np.random.Generator, share: float) -> dict[str, Any]:
    """Random cuts down to single rows or the depth limit, as arrays over nodes.

    The children of an inner node are neighbours, so only the left one is kept; a leaf is its
    own left child and cuts at infinity, so a descent may go on standing still.
    """
    n, p = x.shape
    usable = np.sort(rng.choice(p, size=max(1, int(share * p)), replace=False))
    limit = math.ceil(math.log2(max(n, 2)))
    draws = rng.random((2 * n, 2)).tolist()
    leaf_depth = mean_path(np.arange(n + 1)).tolist()
    if len(usable) == 1:
        column = np.sort(x[:, usable[0]])

        def span(rows: Any, u: float) -> tuple[int, float, float]:
            return 0, float(column[rows[0]]), float(column[rows[1] - 1])

        def split(rows: Any, k: int, at: float) -> tuple[Any, Any]:
            middle = rows[0] + int(np.searchsorted(column[rows[0] : rows[1]], at, side="right"))
            return (rows[0], middle), (middle, rows[1])

        def size(rows: Any) -> int:
            return rows[1] - rows[0]

        everything: Any = (0, n)
    else:
        table = x[:, usable]

        def span(rows: Any, u: float) -> tuple[int, float, float]:
            part = table[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if not len(open_):
                return 0, 0.0, 0.0
            k = int(open_[int(u * len(open_))])
            return k, float(low[k]), float(high[k])

        def split(rows: Any, k: int, at: float) -> tuple[Any, Any]:
            goes_left = table[rows, k] <= at
            return rows[goes_left], rows[~goes_left]

        size = len
        everything = np.arange(n)

    feature, cut, left, path = [0], [math.inf], [0], [0.0]
    todo = [(0, everything, 0)]
    while todo:
        node, rows, depth = todo.pop()
        which, where = draws[node]
        k, low, high = span(rows, which) if depth < limit and size(rows) > 1 else (0, 0.0, 0.0)
        if high <= low:
            left[node], path[node] = node, depth + leaf_depth[size(rows)]
            continue
        at = low + where * (high - low)
        # Rounding must not push the cut up to the highest row, which has to go right.
        at = at if at < high else low
        child = len(cut)
        feature[node], cut[node], left[node] = int(usable[k]), at, child
        feature += [0, 0]
        cut += [math.inf, math.inf]
        left += [child, child + 1]
        path += [0.0, 0.0]
        first, second = split(rows, k, at)
        todo += [(child, first, depth + 1), (child + 1, second, depth + 1)]
    return {"feature": feature, "cut": cut, "left": left, "path": path, "sample": n}


def _stacked(model: dict[str, Any]) -> dict[str, np.ndarray]:
    """The trees as arrays (tree, node); kept in the model, which serves many batches."""
    if "_stacked" not in model:
        width = max(len(c) for c in model["cut"])
        out = {}
        for name, kind in (("feature", int), ("cut", float), ("left", int), ("path", float)):
            out[name] = np.full((len(model[name]), width), math.inf if name == "cut" else 0, dtype=kind)
            for k, v in enumerate(model[name]):
                out[name][k, : len(v)] = v
        model["_stacked"] = out
    return model["_stacked"]


def _depths(x: np.ndarray, model: dict[str, Any]) -> np.ndarray:
    """Mean depth at which vectors end up, all trees descending together."""
    feature, cut, left, path = _stacked(model).values()
    tree = np.arange(len(cut))[:, None]
    levels = math.ceil(math.log2(max(2, max(model["sample"]))))
    out = np.empty(len(x))
    for start in range(0, len(x), 2048):
        part = x[start : start + 2048]
        at = np.zeros((len(cut), len(part)), dtype=int)
        row = np.arange(len(part))[None, :]
        for _ in range(levels):
            limit = cut[tree, at]
            at = left[tree, at] + ((part[row, feature[tree, at]] > limit) & np.isfinite(limit))
        out[start : start + 2048] = path[tree, at].mean(axis=0)
    return out


def _score(depth: np.ndarray, model: dict[str, Any]) -> np.ndarray:
    """2^(−mean depth / expected depth)."""
    expected = float(mean_path(max(model["sample"])))
    return 2.0 ** (-depth / expected) if expected else np.full(len(depth), AUTO_THRESHOLD)


def forest_scores(x: np.ndarray, model: dict[str, Any]) -> np.ndarray:
    """Scores of vectors, which descend all trees."""
    return _score(_depths(x, model), model)


def step_scores(x: np.ndarray, model: dict[str, Any]) -> np.ndarray:
    """Scores of single numbers, looked up in the steps of their forest."""
    return np.asarray(model["scores"][0])[np.searchsorted(np.asarray(model["edges"][0]), x[:, 0], side="left")]


def forest_steps(model: dict[str, Any]) -> tuple[np.ndarray, np.ndarray]:
    """Edges and scores of a forest over single numbers, whose score is a step function.

    A number up to a cut goes left: steps are open on the left and closed on the right, and the
    score of a step is that of its right edge.
    """
    cut = _stacked(model)["cut"]
    edges = np.unique(cut[np.isfinite(cut)])
    points = np.append(edges, edges[-1] + 1 if len(edges) else 0.0)
    depths = np.zeros(len(points))
    for k in range(len(cut)):
        one = {name: [model[name][k]] for name in ("feature", "cut", "left", "path", "sample")}
        own = np.unique(cut[k][np.isfinite(cut[k])])
        inside = np.append(own, own[-1] + 1 if len(own) else 0.0)
        depths += _depths(inside[:, None], one)[np.searchsorted(own, points, side="left")]
    return edges, _score(depths / len(cut), model)


@dataclass(frozen=True)
class IsolationForestModel(DetectorModel):
    name: str
    spec: IsolationForest
    trees: DataFrame
    thresholds: DataFrame | None

    def raw(self, df: DataFrame) -> DataFrame:
        with_x = df.withColumn("_x", self.spec.vector(df))
        most = self.spec.max_samples
        if "edges" in self.trees.columns:
            kernel, model_bytes = step_scores, 16 * most * self.spec.n_estimators
        else:
            kernel, model_bytes = forest_scores, 80 * most
        return apply_models(with_x, self.spec.by, "_x", self.trees, kernel, "_raw", model_bytes).drop("_x")

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.raw(df)
        if self.thresholds is None:
            scored = scored.withColumn("_cut", F.lit(AUTO_THRESHOLD))
        else:
            scored = attach(scored, self.thresholds, self.spec.by, how="left", frozen=True)
        return finish(scored, centred=True)
