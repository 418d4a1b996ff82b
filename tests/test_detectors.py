from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions.chi2 import chi2_quantile
from tideline.operators.detector import Detector, DetectorModel, with_label
from tideline.operators.ensemble import Ensemble
from tideline.operators.envelope import EllipticEnvelope
from tideline.plans.settings import _DEFAULTS
from tideline.operators.isolation import IsolationForest, forest_scores, forest_steps, grow_tree, mean_path, step_scores
from tideline.operators.lof import LocalOutlierFactor
from tideline.operators.neighbours import nearest
from tideline.operators import envelope, recon
from tideline.operators.recon import WindowReconstruction
from tideline.plans import freeze, with_position
from tideline.plans.moments import lag_sums, window_sums

VECTOR = {"inputs": "features", "order": ["row_key"]}


@pytest.fixture
def mixed(vectors):
    """200 normal rows and a cluster of 20 far away."""
    x = np.vstack([np.random.default_rng(42).normal(0, 1, (200, 2)), np.random.default_rng(99).normal(10, 0.5, (20, 2))])
    return vectors(x, np.r_[np.ones(200), -np.ones(20)]), x


@pytest.fixture
def scattered(vectors):
    """200 normal rows and 20 isolated ones; clustered outliers defeat density comparison."""
    rng = np.random.default_rng(5)
    angle, radius = rng.uniform(0, 2 * np.pi, 20), rng.uniform(8, 12, 20)
    far = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])
    x = np.vstack([rng.normal(0, 0.5, (200, 2)), far])
    return vectors(x, np.r_[np.ones(200), -np.ones(20)]), x


def check_contract(detector, df):
    out = detector.fit_transform(df).toPandas()
    assert set(out["label"].unique()) <= {-1, 1}
    assert out[["raw_score", "threshold", "score"]].notna().all().all()
    assert ((out["raw_score"] > out["threshold"]) == (out["label"] == -1)).all()
    odd, plain = out[out["y_true"] == -1], out[out["y_true"] == 1]
    assert odd["score"].mean() > plain["score"].mean()
    assert (odd["label"] == -1).mean() > 0.5
    assert (plain["label"] == 1).mean() > 0.85
    return out


def test_isolation_forest(limits, mixed):
    df, _ = mixed
    out = check_contract(IsolationForest(contamination=0.1, n_estimators=25, **VECTOR), df)
    assert abs((out["label"] == -1).mean() - 0.1) < 0.02


def test_isolation_forest_does_not_depend_on_partitions(mixed):
    df, _ = mixed
    forest = IsolationForest(n_estimators=20, **VECTOR)
    a, b, c = (
        forest.fit_transform(d).orderBy("row_key").toPandas()["raw_score"].tolist()
        for d in (df, df.repartition(7, "row_key"), df.orderBy(F.desc("row_key")).coalesce(1))
    )
    assert a == b == c
    other = IsolationForest(n_estimators=20, seed=1, **VECTOR).fit_transform(df).orderBy("row_key").toPandas()
    assert other["raw_score"].tolist() != a


def test_isolation_forest_feature_share(mixed):
    df, _ = mixed
    model = IsolationForest(n_estimators=10, max_features=0.5, **VECTOR).fit(df)
    used = model.trees.select(F.explode("feature").alias("f"), "_tree").groupBy("_tree").agg(F.max("f") - F.min("f"))
    assert model.trees.count() == 10 and used.count() == 10


def test_forest_steps_equal_descents():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(256, 1)), 2)
    trees = [grow_tree(x, rng, 1.0) for _ in range(30)]
    model = {k: [t[k] for t in trees] for k in trees[0]}
    asked = np.concatenate([np.repeat(x, 10, axis=0), [[-9.0], [9.0]], np.unique(np.concatenate(model["cut"]))[:-1, None]])
    edges, scores = forest_steps(dict(model))
    looked_up = step_scores(asked, {"edges": [edges], "scores": [scores]})
    np.testing.assert_allclose(looked_up, forest_scores(asked, model), rtol=1e-12)


def test_mean_path():
    assert mean_path(1) == 0 and mean_path(2) == 1
    assert mean_path(256) == pytest.approx(10.2448, abs=1e-4)


def brute_lof(x, k, queries=None):
    """Factors by the textbook, on all distances."""
    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    keys = [tuple(r) for r in x]

    def order(row, skip):
        return [j for j in sorted(range(len(x)), key=lambda j: (row[j], keys[j], j)) if j != skip][:k]

    near = [order(d[i], i) for i in range(len(x))]
    kd = np.array([d[i, near[i][-1]] for i in range(len(x))])
    lrd = np.array([1 / (np.mean([max(d[i, j], kd[j]) for j in near[i]]) + 1e-10) for i in range(len(x))])
    if queries is None:
        return np.array([np.mean(lrd[near[i]]) / lrd[i] for i in range(len(x))])
    out = []
    for q in np.asarray(queries, dtype=float).reshape(len(queries), -1):
        row = np.sqrt(((x - q) ** 2).sum(-1))
        js = order(row, None)
        out.append(np.mean(lrd[js]) * (np.mean([max(row[j], kd[j]) for j in js]) + 1e-10))
    return np.array(out)


@pytest.mark.parametrize("k", [1, 8])
def test_lof_of_numbers(limits, series, k):
    rng = np.random.default_rng(k)
    x = np.round(rng.normal(0, 3, 120), 1)
    df = series({"s": x.tolist(), "t": x[:40].tolist()})
    fitted = LocalOutlierFactor(n_neighbors=k, novelty=False).fit_transform(df)
    new = LocalOutlierFactor(n_neighbors=k).fit_transform(df)
    for name, part in (("s", x), ("t", x[:40])):
        got = fitted.where(F.col("series_id") == name).orderBy("ts").toPandas()["raw_score"]
        np.testing.assert_allclose(got, brute_lof(part, k), rtol=1e-9)
        got = new.where(F.col("series_id") == name).orderBy("ts").toPandas()["raw_score"]
        np.testing.assert_allclose(got, brute_lof(part, k, part), rtol=1e-9)


def test_lof_blocks_overlap_enough(spark, series, monkeypatch):
    monkeypatch.setitem(_DEFAULTS, "valueBlock", 1)
    monkeypatch.setitem(_DEFAULTS, "askedRows", 3)
    monkeypatch.setattr("tideline.operators.lof._SLICE", 7)
    x = np.random.default_rng(0).normal(size=150)
    got = LocalOutlierFactor(n_neighbors=4).fit_transform(series({"s": x.tolist()})).orderBy("ts").toPandas()["raw_score"]
    np.testing.assert_allclose(got, brute_lof(x, 4, x), rtol=1e-9)


def test_lof_of_unseen_numbers(limits, series):
    x = np.round(np.random.default_rng(2).normal(0, 3, 60), 1)
    q = np.array([-100.0, -1.23, 0.017, 2.5, 100.0, x[0]])
    model = LocalOutlierFactor(n_neighbors=7).fit(series({"s": x.tolist()}))
    got = model.transform(series({"s": q.tolist()})).orderBy("ts").toPandas()["raw_score"]
    np.testing.assert_allclose(got, brute_lof(x, 7, q), rtol=1e-9)


def test_lof_with_many_copies(series):
    x = [1.0] * 60 + [2.0, 3.0, 50.0]
    got = LocalOutlierFactor(n_neighbors=5, novelty=False).fit_transform(series({"s": x})).orderBy("ts").toPandas()["raw_score"]
    np.testing.assert_allclose(got, brute_lof(x, 5), rtol=1e-6)


def test_lof_of_few_rows(series):
    out = LocalOutlierFactor().fit_transform(series({"one": [3.0], "two": [1.0, 2.0]})).toPandas()
    assert (out["label"] == 1).all()


@pytest.mark.parametrize("novelty", [True, False])
def test_lof_of_vectors(scattered, novelty):
    df, x = scattered
    out = check_contract(LocalOutlierFactor(n_neighbors=10, novelty=novelty, **VECTOR), df).sort_values("row_key")
    np.testing.assert_allclose(out["raw_score"], brute_lof(x, 10, x if novelty else None), rtol=1e-9)


def test_lof_of_repeated_and_unseen_vectors(limits, vectors):
    rng = np.random.default_rng(8)
    x = np.vstack([np.tile([[1.0, 1.0]], (30, 1)), rng.integers(0, 6, (50, 2))]).astype(float)
    q = np.vstack([x[:2], rng.normal(3, 4, (5, 2))])
    model = LocalOutlierFactor(n_neighbors=4, **VECTOR).fit(vectors(x))
    got = model.transform(vectors(q)).orderBy("row_key").toPandas()["raw_score"]
    np.testing.assert_allclose(got, brute_lof(x, 4, q), rtol=1e-6)


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_nearest(limits, spark, metric):
    x = np.random.default_rng(4).normal(size=(150, 3))
    df = spark.createDataFrame([("g", [float(c) for c in r], 1) for r in x], "g string, _x array<double>, _m bigint")
    known = freeze(with_position(freeze(df), ["g"], ["_x"], "_vid"))
    places = known.orderBy("_vid").toPandas()
    x = np.vstack(places["_x"])
    gap = np.abs(x[:, None] - x[None])
    d = {"euclidean": np.sqrt((gap**2).sum(-1)), "manhattan": gap.sum(-1), "chebyshev": gap.max(-1)}[metric]
    got = nearest(known, known, ["g"], 6, metric).collect()
    assert len(got) == 150
    for r in got:
        assert [c["vid"] for c in r["_near"]] == np.argsort(d[r["_qid"]], kind="stable")[:6].tolist()


def brute_envelope(x, contamination):
    """One-dimensional minimum covariance determinant, corrected and reweighted, on sorted rows."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    h = min(n, int(np.ceil((n + 2) / 2)))
    s = np.sort(x)
    location = x.mean()
    if h < n:
        length = s[h:] - s[: n - h]
        location = (0.5 * (s[h:] + s[: n - h]))[length == length.min()].mean()
    near = sorted(range(n), key=lambda i: (round(abs(x[i] - location), 9), x[i]))[:h]
    variance = x[near].var()
    d = (x - location) ** 2 / variance
    kept = x[d / (np.median(d) / 0.454936) < 5.023886]
    d = (x - kept.mean()) ** 2 / kept.var()
    return d, np.quantile(d, 1 - contamination)


@pytest.mark.parametrize("n", [3, 101])
def test_envelope_of_numbers(limits, series, n):
    x = np.round(np.random.default_rng(n).normal(10, 3, n), 1)
    x[0] = 80.0
    out = EllipticEnvelope(contamination=0.1).fit_transform(series({"s": x.tolist()})).orderBy("ts").toPandas()
    d, cut = brute_envelope(x, 0.1)
    np.testing.assert_allclose(out["raw_score"], d, rtol=1e-7)
    np.testing.assert_allclose(out["threshold"], cut, rtol=1e-7)
    np.testing.assert_allclose(out["score"], out["raw_score"] - out["threshold"])


def test_envelope_without_spread_has_no_verdict(limits, series):
    out = EllipticEnvelope().fit_transform(series({"flat": [5.0] * 9, "s": range(9)})).toPandas().set_index("series_id")
    assert out.loc["flat", "label"].isna().all() and out.loc["s", "label"].notna().all()


def test_envelope_of_vectors(limits, mixed):
    df, x = mixed
    out = check_contract(EllipticEnvelope(contamination=0.1, **VECTOR), df)
    assert (out["label"] == -1).sum() == 22
    assert (out["raw_score"] >= 0).all()
    # The far cluster must not pull the centre.
    clean = x[:200]
    inv = np.linalg.inv(np.cov(clean.T))
    want = np.einsum("ij,jk,ik->i", clean - clean.mean(0), inv, clean - clean.mean(0))
    got = out.sort_values("row_key")["raw_score"].to_numpy()[:200]
    assert np.corrcoef(got, want)[0, 1] > 0.99


@pytest.mark.parametrize("band", [16 * 5 * 100, 16 * 5 * 5000])
def test_envelope_settles_where_plain_steps_are_too_few(spark, vectors, monkeypatch, band):
    """Rows about the border, or all rows, settle among themselves; the end is one that a step over all rows leaves as it is."""
    x = np.random.default_rng(3).uniform(-1, 1, (1500, 4))
    x[::60] *= 10
    df, narrowed, shapes = vectors(x), EllipticEnvelope._narrowed, []
    detector = EllipticEnvelope(max_steps=20, start_rows=60, starts=10, **VECTOR)
    monkeypatch.setattr(envelope, "_BAND_BYTES", band)
    monkeypatch.setattr(EllipticEnvelope, "_narrowed", lambda self, *a: shapes.append(narrowed(self, *a)) or shapes[-1])
    out = detector.fit_transform(df)
    assert out.where("label = -1").count() == 150 and out.where("label = -1 and row_key % 60 = 0").count() == 25
    shape = shapes[-1].first()
    c = x - np.array(shape["location"])
    d = ((c @ np.array(shape["precision"]).reshape(4, 4)) * c).sum(axis=1)
    kept = x[np.argsort(d, kind="stable")[: (1500 + 5 + 1) // 2]]
    assert abs(np.linalg.slogdet(np.cov(kept.T, bias=True))[1] - shape["log_det"]) <= 1e-8
    # Steps over all rows alone do not get there.
    monkeypatch.setattr(EllipticEnvelope, "_narrowed", lambda self, rows, model, *rest: model)
    with pytest.raises(RuntimeError, match="not settled in 20 steps"):
        detector.fit(df)


def test_envelope_without_series_settles_where_no_row_is_sure_to_stay(vectors, monkeypatch):
    """The same of a table that is one series without a name, all of whose rows lie about the border."""
    x = np.random.default_rng(3).uniform(-1, 1, (1500, 4))
    x[::60] *= 10
    narrowed, shapes = EllipticEnvelope._narrowed, []
    monkeypatch.setattr(EllipticEnvelope, "_narrowed", lambda self, *a: shapes.append(narrowed(self, *a)) or shapes[-1])
    out = EllipticEnvelope(max_steps=2, start_rows=60, starts=10, by=[], **VECTOR).fit_transform(vectors(x).drop("series_id"))
    assert out.where("label = -1").count() == 150 and out.where("label = -1 and row_key % 60 = 0").count() == 25
    shape = shapes[-1].first()
    c = x - np.array(shape["location"])
    d = ((c @ np.array(shape["precision"]).reshape(4, 4)) * c).sum(axis=1)
    kept = x[np.argsort(d, kind="stable")[: (1500 + 5 + 1) // 2]]
    assert abs(np.linalg.slogdet(np.cov(kept.T, bias=True))[1] - shape["log_det"]) <= 1e-8


def test_chi2():
    # Published quantiles.
    for q, dof, want in [(0.5, 1, 0.454936), (0.975, 1, 5.023886), (0.5, 2, 1.386294), (0.975, 10, 20.483177), (0.975, 64, 88.004051)]:
        assert chi2_quantile(q, dof) == pytest.approx(want, abs=1e-5)


def test_reconstruction(limits, series):
    rng = np.random.default_rng(0)
    wave = np.sin(np.arange(200) / 4) + rng.normal(0, 0.05, 200)
    odd = wave.copy()
    odd[120] += 6
    detector = WindowReconstruction(window_size=10, n_components=3)
    df = series({"s": wave.tolist(), "t": odd.tolist(), "short": [1.0] * 5})
    out = detector.fit_transform(df).toPandas()
    assert out.groupby("series_id").size().to_dict() == {"s": 191, "t": 191}
    assert (out["raw_score"] >= 0).all()
    share = (out["label"] == -1).groupby(out["series_id"]).mean()
    assert (share - 0.05).abs().max() < 0.02
    worst = out[out["series_id"] == "t"].sort_values("raw_score").tail(1)
    assert 120 <= worst["row_key"].iloc[0] <= 129
    assert ((out["raw_score"] > out["threshold"]) == (out["label"] == -1)).all()


def test_reconstruction_of_other_data(spark):
    rng = np.random.default_rng(1)

    def rows(n, centre):
        x = rng.normal(centre, 0.5, (n, 2))
        return spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "series_id string, row_key int, a double, b double")

    detector = WindowReconstruction(window_size=8, inputs=("a", "b"), order=["row_key"])
    model = detector.fit(rows(200, 0))
    usual = model.transform(rows(50, 0)).agg(F.avg("raw_score")).first()[0]
    far = model.transform(rows(50, 20)).agg(F.avg("raw_score"), F.min("label"), F.max("label")).first()
    assert far[0] > usual and (far[1], far[2]) == (-1, -1)


def test_reconstruction_of_ready_windows(spark, series):
    df = series({"s": np.random.default_rng(0).normal(size=60).tolist()})
    detector = WindowReconstruction(window_size=6)
    windows = detector.windows(df)
    ready = WindowReconstruction(window_size=6, inputs="_w", windowed=True)
    a = detector.fit_transform(df).orderBy("ts").toPandas()["raw_score"]
    b = ready.fit_transform(windows).orderBy("ts").toPandas()["raw_score"]
    np.testing.assert_allclose(a, b, rtol=1e-9)


@pytest.mark.parametrize("size", [1, 2, 7, 20])
def test_window_sums(limits, spark, size):
    """The sums over windows without windows, with nulls, several inputs and series too short for a window."""
    rng = np.random.default_rng(size)
    held = {"a": rng.normal(1e6, 3, (90, 2)), "b": rng.normal(0, 1, (20, 2)), "c": rng.normal(0, 1, (3, 2)), None: rng.normal(5, 1, (45, 2))}
    rows, want = [], {}
    for name, x in held.items():
        gone = {4, 30, 31} if len(x) > 40 else set()
        rows += [(name, i, None if i in gone else [float(v) for v in r]) for i, r in enumerate(x)]
        z = [np.r_[1.0, x[i : i + size].ravel()] for i in range(len(x) - size + 1) if not gone & set(range(i, i + size))]
        if z:
            want[name] = np.vstack(z).T @ np.vstack(z)
    df = spark.createDataFrame(rows, "s string, i int, x array<double>").repartition(4)
    got = {}
    for r in window_sums(df, ["s"], ["i"], "x", size).collect():
        got.setdefault(r.s, {})[r.i] = r.total
    assert got.keys() == want.keys()
    for name, m in want.items():
        np.testing.assert_allclose([got[name][k] for k in range(m.size)], m.ravel(), rtol=1e-9, atol=1e-6)


def test_lag_sums_keep_small_differences():
    x = 1e8 + np.random.default_rng(3).normal(0, 1, (500, 1))
    z = np.array([np.r_[1.0, x[i : i + 5, 0]] for i in range(496)])
    np.testing.assert_allclose(lag_sums(x, 5), z.T @ z, rtol=1e-12)


def test_reconstruction_fits_on_rows(series, monkeypatch):
    """Training writes no table of windows, and the basis is that of the windows."""
    written = []
    monkeypatch.setattr(recon, "freeze", lambda df, label: written.append((label, df.columns)) or freeze(df, label))
    df = series({"s": np.random.default_rng(0).normal(size=80).tolist(), "t": [*range(30), None, *range(30)]})
    detector = WindowReconstruction(window_size=6)
    got = {r.series_id: r for r in detector.fit(df).models.collect()}
    assert not any("_w" in columns for _, columns in written)
    ready = WindowReconstruction(window_size=6, inputs="_w", windowed=True).fit(detector.windows(df))
    for r in ready.models.collect():
        np.testing.assert_allclose(got[r.series_id].mean, r.mean, rtol=1e-9)
    a, b = (m.errors(d).orderBy("series_id", "ts").toPandas()["_raw"] for m, d in ((detector.fit(df), df), (ready, detector.windows(df))))
    np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9)


def test_reconstruction_refuses_short_series(series):
    with pytest.raises(ValueError, match="window_size"):
        WindowReconstruction(window_size=20, short="error").fit(series({"s": range(5)}))


def test_missing_values_have_no_verdict(series):
    x = [*np.random.default_rng(0).normal(size=30).tolist(), None]
    df = series({"s": x})
    for d in (IsolationForest(n_estimators=5), LocalOutlierFactor(n_neighbors=3), EllipticEnvelope()):
        out = d.fit_transform(df).toPandas()
        assert len(out) == 31 and out["label"].isna().sum() == 1


@pytest.mark.parametrize("make", [lambda: IsolationForest(contamination=0.9), lambda: EllipticEnvelope(contamination="auto"), lambda: LocalOutlierFactor(metric="cosine"), lambda: LocalOutlierFactor(n_neighbors=0)])
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


class Above(Detector):
    """A detector of one's own."""

    def __init__(self, name, limit, **keys):
        super().__init__(name, **keys)
        self.limit = limit

    def fit(self, df):
        return AboveModel(self.name, self.limit)


class AboveModel(DetectorModel):
    def __init__(self, name, limit):
        self.name, self.limit = name, limit

    def transform(self, df):
        return with_label(df.withColumn("raw_score", F.col("value")).withColumn("threshold", F.lit(float(self.limit))), centred=True)


def test_ensemble(limits, series):
    df = series({"s": list(range(10))}, is_anomaly=[0] * 7 + [1] * 3)
    both = Ensemble([Above("a", 6), Above("b", 7), Above("c", 4)])
    with pytest.raises(ValueError):
        both.add(Above("a", 1))
    for wrong in (both.compare, both.vote):
        with pytest.raises(ValueError):
            wrong()
    results = both.run(df, "is_anomaly", "one_is_anomaly")
    assert results.count() == 30 and both.compare().count() == 3
    f1 = {r["detector"]: r["f1"] for r in both.compare().collect()}
    assert f1["a"] == 1 and f1["b"] == pytest.approx(0.8) and f1["c"] == pytest.approx(0.75)
    found = {s: both.vote(s).where("label = -1").count() for s in ("unanimous", "majority", "any")}
    assert found == {"unanimous": 2, "majority": 3, "any": 5}
    with pytest.raises(ValueError):
        both.vote("weighted")
    with pytest.raises(ValueError):
        Ensemble().run(df)
    plain = Ensemble([Above("a", 6)])
    plain.run(df)
    with pytest.raises(ValueError):
        plain.compare()


def test_ensemble_with_windowed_detector(series):
    x = np.random.default_rng(0).normal(size=40).tolist()
    mixed = Ensemble([Above("a", 1), WindowReconstruction(window_size=10)])
    mixed.run(series({"s": x}))
    votes = mixed.vote().toPandas()
    assert len(votes) == 40 and sorted(votes["voters"].unique()) == [1, 2]


def test_inputs_named_like_outputs(limits, series):
    """Columns of the rows that bear names the detectors use are left alone, or replaced by the outputs."""
    values = [float(i % 7) for i in range(40)] + [300.0]
    df = series({"s": values}).select("series_id", "ts", "row_key", F.col("value").alias("score"), F.lit(5.0).alias("threshold"), F.lit("x").alias("location"), F.lit(0).alias("label"))
    for detector in (EllipticEnvelope(inputs="score"), LocalOutlierFactor(inputs="score"), IsolationForest(inputs="score", n_estimators=20)):
        out = detector.fit_transform(df)
        assert out.columns.count("threshold") == 1 and "location" in out.columns
        worst = out.orderBy(F.desc("raw_score")).first()
        assert worst["label"] == -1 and worst["location"] == "x"
    ensemble = Ensemble([EllipticEnvelope(inputs="score"), LocalOutlierFactor(inputs="score"), IsolationForest(inputs="score", n_estimators=20)])
    results = ensemble.run(df.withColumn("label", F.when(F.col("row_key") < 4, 0).otherwise(1)), "label")
    assert results.where("y_true = -1").count() == 12
    assert ensemble.compare().agg(F.max("recall")).first()[0] < 1


def test_one_group_and_short_groups(limits, series):
    df = series({"s": [float(i % 5) for i in range(30)] + [80.0], "t": [1.0, 2.0]})
    flat = EllipticEnvelope(by=[]).fit_transform(df.where("series_id = 's'"))
    assert flat.count() == 31 and flat.where("label = -1").count() >= 1
    out = EllipticEnvelope(support_fraction=0.05).fit_transform(df)
    assert out.count() == 33
    same = EllipticEnvelope(by=[]).fit_transform(df.where("series_id = 't'").withColumn("value", F.lit(3.0)))
    assert same.count() == 2 and same.where("label is not null").count() == 0


def test_half_of_the_values_equal(limits, series):
    out = EllipticEnvelope().fit_transform(series({"s": [0.0] * 30 + [float(i) for i in range(1, 20)] + [1000.0], "t": [0.0] * 49 + [9.0]}))
    assert out.where("label is null").count() == 0
    worst = {r["series_id"]: r["value"] for r in out.where("label = -1").groupBy("series_id").agg(F.max("value").alias("value")).collect()}
    assert worst == {"s": 1000.0, "t": 9.0}


def test_many_ask_in_one_block(spark, series, monkeypatch):
    monkeypatch.setitem(_DEFAULTS, "askedRows", 500)
    model = LocalOutlierFactor(n_neighbors=5).fit(series({"s": [float(i) for i in range(50)]}))
    asked = spark.range(20_000).select(F.lit("s").alias("series_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("id").alias("row_key"), (F.col("id") / 400).alias("value"))
    out = model.transform(asked)
    assert out.count() == 20_000 and out.where("raw_score is null").count() == 0
    one = model.transform(asked.where("row_key % 997 = 0")).orderBy("row_key").collect()
    many = out.where("row_key % 997 = 0").orderBy("row_key").collect()
    assert [r["raw_score"] for r in one] == [r["raw_score"] for r in many]


def test_duplicate_keys_are_refused_with_windows(series):
    df = series({"s": [float(i) for i in range(40)]})
    with pytest.raises(ValueError, match="unique"):
        Ensemble([WindowReconstruction(window_size=5)]).run(df.union(df))
