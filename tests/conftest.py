from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from session import local_session  # noqa: E402

# Limits small enough that the fixtures are cut into chunks, blocks and shares.
TINY = {
    "spark.tideline.maxGroupRows": "5",
    "spark.tideline.chunkRows": "7",
    "spark.tideline.broadcastBytes": "1",
    "spark.tideline.blockRows": "16",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(cpus=4, name="tests", **{"spark.checkpoint.dir": shared, "spark.sql.shuffle.partitions": "3"})
    yield session
    session.stop()


@pytest.fixture(params=["whole", "cut"])
def limits(request, spark):
    """Run a test with the usual limits and again with tiny ones."""
    if request.param == "cut":
        for key, value in TINY.items():
            spark.conf.set(key, value)
    yield request.param
    for key in TINY:
        spark.conf.unset(key)


def day(i: int, start: dt.datetime = dt.datetime(2024, 1, 1)) -> dt.datetime:
    return start + dt.timedelta(days=i)


@pytest.fixture
def series(spark):
    """Make ``(series_id, ts, row_key, value, …)`` from values per series."""

    def make(values: dict[str, list], **extra: list):
        rows = []
        for name, numbers in values.items():
            for i, v in enumerate(numbers):
                rows.append((name, day(i), i, None if v is None else float(v), *[extra[k][i] for k in extra]))
        columns = "series_id string, ts timestamp_ntz, row_key bigint, value double"
        kinds = "".join(f", {k} int" for k in extra)
        return spark.createDataFrame(rows, columns + kinds)

    return make


@pytest.fixture
def vectors(spark):
    def make(x: np.ndarray, truth: np.ndarray | None = None):
        truth = np.ones(len(x)) if truth is None else truth
        rows = [("m", i, [float(c) for c in row], int(t)) for i, (row, t) in enumerate(zip(x, truth))]
        return spark.createDataFrame(rows, "series_id string, row_key bigint, features array<double>, y_true int")

    return make
