from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tideline.operators.envelope import EllipticEnvelope
from tideline.operators.lof import LocalOutlierFactor
from tideline.operators.recon import WindowReconstruction
from tideline.streaming.scoring import score_stream
from tideline.streaming.windows import band, outside_band, read_batches, refreshed, start_closed, tumbling


@pytest.mark.parametrize("detector", [EllipticEnvelope(), LocalOutlierFactor(n_neighbors=3)])
def test_stream_equals_batch(spark, series, tmp_path, detector):
    df = series({"a": range(20), "b": [*range(9), 100]})
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    model = detector.fit(df)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    order = ["series_id", "ts"]
    a = score_stream(stream, model).orderBy(order).select(*order, "raw_score", "label").collect()
    b = model.transform(df).orderBy(order).select(*order, "raw_score", "label").collect()
    assert a == b and len(a) == 30


def test_windows_are_refused(spark, series, tmp_path):
    df = series({"a": range(20)})
    df.write.parquet(str(tmp_path / "in"))
    model = WindowReconstruction(window_size=5).fit(df)
    with pytest.raises(ValueError):
        score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), model)


def test_tumbling_stream_equals_batch(spark, series, tmp_path):
    df = series({"a": range(20), "b": [1, None, 3]})
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    a = refreshed(tumbling(stream, "7 days")).orderBy("series_id", "start").collect()
    b = tumbling(df, "7 days").orderBy("series_id", "start").collect()
    assert a == b and sum(r["n"] for r in a) == 22
    assert tumbling(stream, "7 days", late="1 day").isStreaming


def test_input_column_called_batch(spark, series, tmp_path):
    df = series({"a": range(20)}).withColumn("batch", F.lit("x"))
    df.write.parquet(str(tmp_path / "in"))
    out = score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), EllipticEnvelope().fit(df))
    assert {r["batch"] for r in out.collect()} == {"x"}


def arriving(spark, path, frames):
    """A stream that meets one file of rows a time, in the order of their names."""
    import os
    import time

    for i, df in enumerate(frames):
        folder = str(path / f"new-{i}")
        df.coalesce(1).write.parquet(folder)
        name = next(n for n in os.listdir(folder) if n.endswith(".parquet"))
        os.makedirs(path / "in", exist_ok=True)
        target = path / "in" / f"{i}.parquet"
        os.rename(f"{folder}/{name}", target)
        os.utime(target, (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


def at(spark, *days):
    import datetime as dt

    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=d), i, float(v)) for i, (d, v) in enumerate(days)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, row_key bigint, value double")


def test_closed_windows_refuse_late_rows(spark, tmp_path):
    # One window per day; the fourth file has a row for a window that ended long before.
    frames = [at(spark, (0, 1), (0.5, 2)), at(spark, (1, 3), (2, 4)), at(spark, (6, 5)), at(spark, (0.2, 100), (7, 6))]
    stream = arriving(spark, tmp_path, frames)
    windows = tumbling(stream, "1 day", late="1 day")
    query = start_closed(windows, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    out = read_batches(spark, str(tmp_path / "out"), windows.schema).orderBy("start").collect()
    # 100 is not counted; the days of 6 and 7 have not ended.
    assert [(r["start"].day, r["n"], r["total"]) for r in out] == [(1, 2, 3.0), (2, 1, 3.0), (3, 1, 4.0)]
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1


def test_state_is_dropped(spark, tmp_path):
    frames = [at(spark, *[(3 * i + d / 10, 1) for d in range(10)]) for i in range(12)]
    windows = tumbling(arriving(spark, tmp_path, frames), "1 day", late="1 day")
    query = start_closed(windows, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(totals) <= 3 and len(totals) >= 12
    out = read_batches(spark, str(tmp_path / "out"), windows.schema)
    assert out.count() == 11 and out.agg({"n": "sum"}).first()[0] == 110


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    days = [(d, 1 if d != 5 else 50) for d in range(12)]
    past = at(spark, *[(d, 1 + d % 2) for d in range(20)])
    bounds = band(tumbling(past, "1 day"))
    assert band(tumbling(past, "1 day"), width=0).first()["lower"] == 1.5
    for part in (days[:6], days[6:]):
        arriving(spark, tmp_path / f"part-{part[0][0]}", [at(spark, x) for x in part])
    import shutil

    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = spark.readStream.schema(past.schema).parquet(str(folder))
        windows = outside_band(tumbling(stream, "1 day", late="1 day"), bounds)
        start_closed(windows, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return read_batches(spark, str(tmp_path / "out"), windows.schema).orderBy("start").collect()

    seen = []
    for k, first in enumerate((0, 6)):
        for path in sorted((tmp_path / f"part-{first}" / "in").iterdir()):
            shutil.copy(path, folder / f"{k}-{path.name}")
        seen.append(run())
    # No window is written twice, and the second run knows the windows that the first left open.
    assert [[r["start"].day for r in rows] for rows in seen] == [[1, 2, 3, 4], list(range(1, 11))]
    assert [r["start"].day for r in seen[1] if r["is_anomaly"]] == [6]


def test_scoring_goes_on_with_a_loaded_model(spark, series, tmp_path):
    from tideline.plans import scratch_scope, store
    from tideline.streaming.scoring import start_scoring

    df = series({"a": [*range(20), 500]})
    with scratch_scope(spark):
        store.save(LocalOutlierFactor(n_neighbors=3).fit(df), str(tmp_path / "models"), spark)
    for i, part in enumerate(df.randomSplit([0.5, 0.5], 1)):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        model = store.load(spark, str(tmp_path / "models"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        start_scoring(stream, model, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    want = LocalOutlierFactor(n_neighbors=3).fit(df).transform(df)
    shown = ["row_key", "raw_score", "label"]
    assert sorted(out.select(shown).collect()) == sorted(want.select(shown).collect())


def test_a_batch_writes_and_reads_its_own_blocks(spark, series, monkeypatch):
    """What a look-up writes does not depend on how much was fitted, and it reads the blocks that it hits."""
    from tideline.operators import lof

    written = []
    plain = lof.freeze

    def counted(df, *args):
        out = plain(df, *args)
        written.append(lof.rows_of(out))
        return out

    asked = series({"a": [3.25, 3.5, 9.5, None]})
    for setting in ("valueBlock", "valueParts"):
        spark.conf.set(f"spark.tideline.{setting}", "16")
    try:
        sizes = []
        for n in (200, 2000):
            model = LocalOutlierFactor(n_neighbors=3).fit(series({"a": [i / 4 for i in range(n)], "b": range(5)}))
            assert model.edges.count() == -(-n // 16) + 1
            with monkeypatch.context() as m:
                m.setattr(lof, "freeze", counted)
                written.clear()
                out = model.transform(asked)
                sizes.append(list(written))
                factors = model._look_up(asked.where("value is not null").select("series_id", F.col("value").alias("_v")))
            # At most as many folders as values asked, named when the job is planned.
            plan = factors._jdf.queryExecution().executedPlan().toString()
            hit = re.search(r"PartitionFilters: \[.*?_part#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
            assert len((hit[1] or hit[2]).split(",")) <= 3
            assert out.where("raw_score is not null").count() == 3
        assert sizes[0] == sizes[1] and max(sizes[0]) == 3
    finally:
        for setting in ("valueBlock", "valueParts"):
            spark.conf.unset(f"spark.tideline.{setting}")
