"""Model folders: what is saved is what is loaded, versions, and publishing that fails half-way."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators.detector import Detector, DetectorModel
from tideline.operators.envelope import EllipticEnvelope
from tideline.operators.forecast import Forecaster
from tideline.operators.isolation import IsolationForest
from tideline.operators.lof import LocalOutlierFactor
from tideline.operators.recon import WindowReconstruction
from tideline.operators.scaling import Scaler
from tideline.plans import scratch_scope, store

DETECTORS = [
    EllipticEnvelope(contamination=0.2),
    LocalOutlierFactor(n_neighbors=4),
    LocalOutlierFactor(n_neighbors=4, contamination=0.2, novelty=False),
    IsolationForest(n_estimators=5),
    IsolationForest(n_estimators=5, contamination=0.1),
    WindowReconstruction(window_size=4, n_components=2),
]


def rows(df):
    return sorted(map(str, df.collect()))


def refit(spark, make, path, fit, use):
    """What ``use`` gives with a model and with the one loaded after the fitted tables are gone."""
    with scratch_scope(spark):
        model = fit(make)
        version = store.save(model, path, spark)
        before = rows(use(model))
    return before, rows(use(store.load(spark, path, version)))


@pytest.mark.parametrize("detector", DETECTORS, ids=lambda d: f"{d.name}-{getattr(d, 'contamination', '')}")
def test_detectors(spark, series, limits, tmp_path, detector):
    draw = np.random.default_rng(1)
    df = series({"a": [*draw.normal(0, 1, 30), 40], "b": [*draw.normal(5, 2, 20), None]})
    before, after = refit(spark, detector, str(tmp_path / "models"), lambda d: d.fit(df), lambda m: m.transform(df))
    assert before == after and before


@pytest.mark.parametrize("kind", [EllipticEnvelope, LocalOutlierFactor, IsolationForest])
def test_vector_detectors(spark, vectors, tmp_path, kind):
    df = vectors(np.random.default_rng(2).normal(0, 1, (60, 3)))
    detector = kind(inputs="features", order=["row_key"])
    before, after = refit(spark, detector, str(tmp_path / "models"), lambda d: d.fit(df), lambda m: m.transform(df))
    assert before == after and len(before) == 60


def test_scaler_and_forecaster(spark, series, tmp_path):
    df = series({"a": range(30), "b": [7] * 12})
    for made, use in [
        (Scaler(["value"], "robust"), lambda m: m.inverse_transform(m.transform(df))),
        (Forecaster(n_changepoints=3, yearly_seasonality=False), lambda m: m.predict(df, 4)),
        (Forecaster(n_changepoints=3, yearly_seasonality=False, seasonality_mode="multiplicative"), lambda m: m.in_sample(df)),
    ]:
        before, after = refit(spark, made, str(tmp_path / "models"), lambda d: d.fit(df), use)
        assert before == after
    assert store.versions(spark, str(tmp_path / "models")) == [1, 2, 3]


def test_versions(spark, series, tmp_path):
    path = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    for n in (1, 2, 3):
        assert store.save(Scaler(["value"]).fit(series({"a": [0, 2 * n]})), path, spark) == n
    centre = lambda version=None: store.load(spark, path, version).params.first()["_center0"]
    assert [centre(1), centre(2), centre(3), centre()] == [1.0, 2.0, 3.0, 3.0]
    with pytest.raises(FileNotFoundError, match="no version 9"):
        store.load(spark, path, 9)


def test_unpublished_writes_are_not_seen(spark, series, tmp_path, monkeypatch):
    path = str(tmp_path / "models")
    model = Scaler(["value"]).fit(series({"a": [1, 2]}))
    store.save(model, path, spark)

    def fail(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(store, "versions", fail)
        with pytest.raises(OSError):
            store.save(model, path, spark)
    assert store.versions(spark, path) == [1]
    # A writer that claimed a number and never published it does not stop the next one.
    files, place = store.file_system(spark, f"{path}/claims/{2:010d}")
    assert files.createNewFile(place)
    assert store.save(model, path, spark) == 3 and store.versions(spark, path) == [1, 3]


class Half(Detector):
    """A detector of one's own that does not keep what it was made with."""

    def __init__(self, secret: int) -> None:
        super().__init__("half")

    def fit(self, df):
        raise NotImplementedError


class HalfModel(DetectorModel):
    def __init__(self, spec: Detector, name: str) -> None:
        self.spec, self.name = spec, name

    def transform(self, df):
        return df.withColumn("label", F.lit(1))


def test_parameters_must_be_kept(spark, tmp_path):
    with pytest.raises(TypeError, match="secret"):
        store.save(HalfModel(Half(3), "x"), str(tmp_path / "models"), spark)
    store.save(HalfModel(LocalOutlierFactor(), "mine"), str(tmp_path / "models"), spark)
    loaded = store.load(spark, str(tmp_path / "models"))
    assert loaded.name == "mine" and loaded.spec.n_neighbors == 20
