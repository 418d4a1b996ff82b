from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.sources import series as S
from tideline.sources.synthetic import clean_value, generate
from tideline.sources.tables import fetch_series, jdbc_options, result_rows, series_rows


def write(tmp_path, text, name="data.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path, "date,value,is_anomaly\n2024-01-02,2.5,0\n2024-01-01,1,1\n")
    out = S.read_csv(spark, path, extra={"is_anomaly": "int"}).orderBy("ts").collect()
    assert [r["value"] for r in out] == [1.0, 2.5]
    assert [r["is_anomaly"] for r in out] == [1, 0] and isinstance(out[0]["is_anomaly"], int)
    assert out[0]["series_id"].endswith("/data.csv") and out[0]["ts"] == dt.datetime(2024, 1, 1)


def test_csv_with_other_names(spark, tmp_path):
    path = write(tmp_path, "ts,price\n2024-01-01,10.5\n2024-01-02,11.0\n")
    out = S.read_csv(spark, path, "ts", "price")
    assert out.columns == ["series_id", "ts", "row_key", "price"] and out.count() == 2


@pytest.mark.parametrize(
    "text", ["day,value\n2024-01-01,1\n", "date,amount\n2024-01-01,1\n", "date,value\n"]
)
def test_csv_refused(spark, tmp_path, text):
    with pytest.raises(ValueError):
        S.read_csv(spark, write(tmp_path, text))


@pytest.mark.parametrize("text", ["date,value\n2024-01-01,abc\n", "date,value,note\n2024-01-01,1,hello\n", "date,value\nnever,1\n"])
def test_csv_bad_cells_raise(spark, tmp_path, text):
    with pytest.raises(Exception):
        S.read_csv(spark, write(tmp_path, text)).collect()


def test_standardise(spark):
    df = spark.createDataFrame([("2024-01-01", 1, "x", float("nan"))], "day string, a int, note string, b double")
    out = S.standardise(df, "day")
    assert out.columns == ["series_id", "ts", "row_key", "a", "b"]
    row = out.first()
    assert row["a"] == 1.0 and row["b"] is None and row["ts"] == dt.datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        S.standardise(df, "nope")
    with pytest.raises(ValueError):
        S.standardise(df, "day", "nope")
    with pytest.raises(ValueError):
        S.standardise(df.select("day", "note"), "day")
    with pytest.raises(Exception):
        S.standardise(df, "day", "note").collect()


def test_detect_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "ds int, is_anomaly double, Close double")
    assert S.detect_date_column(df) == "ds"
    assert S.detect_value_column(df) == "Close"
    assert S.detect_analysis_column(df) == "Close"
    other = spark.createDataFrame([("a", 0, 5.0)], "when string, is_anomaly int, level double")
    assert S.detect_date_column(other) == "when"
    assert S.detect_value_column(other) == "is_anomaly"
    assert S.detect_analysis_column(other) == "level"
    with pytest.raises(ValueError):
        S.detect_value_column(other.select("when"))


def test_tickers(spark):
    df = spark.createDataFrame([(" aapl ",), ("BRK.B",), ("^GSPC",), ("bad ticker",), ("",), ("A" * 21,)], "t string")
    out = [r[0] for r in df.select(S.normalise_ticker("t")).collect()]
    assert out == ["AAPL", "BRK.B", "^GSPC", None, None, None]


def test_ohlcv(spark):
    rows = [("A", dt.datetime(2024, 1, d), float(d), float(d) + 1) for d in range(1, 6)] + [("B", dt.datetime(2024, 1, 2), 9.0, 9.5)]
    df = spark.createDataFrame(rows, "ticker string, date timestamp_ntz, Open double, Close double")
    out = S.select_ohlcv(df, ["A"], dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 4))
    assert sorted(r["Close"] for r in out.collect()) == [3.0, 4.0]
    with pytest.raises(ValueError):
        S.select_ohlcv(df, ["A"], dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 4))
    with pytest.raises(ValueError):
        S.select_ohlcv(df, ["A"], dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 4), "Volume")


def test_series_table(spark):
    df = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1), 1.0), (2, "b", dt.datetime(2024, 1, 1), 2.0)], "id bigint, name string, ts timestamp_ntz, value double")
    got = fetch_series(df, "a")
    assert [r["value"] for r in got.collect()] == [1.0]
    assert series_rows(got).columns == ["name", "ts", "value"]
    with pytest.raises(ValueError):
        fetch_series(df, "nope")
    with pytest.raises(ValueError):
        series_rows(df.drop("value"))


def test_jdbc_options():
    plain = jdbc_options("jdbc:x", "t")
    assert plain["dbtable"] == "t" and "numPartitions" not in plain
    cut = jdbc_options("jdbc:x", "t", (1, 100), 8, {"user": "u"})
    assert (cut["partitionColumn"], cut["lowerBound"], cut["upperBound"], cut["numPartitions"]) == ("id", "1", "100", "8")
    assert cut["user"] == "u"


def test_result_documents(spark, series, limits):
    df = series({"a": range(10), "b": range(3)}).withColumn("detector", F.lit("d"))
    df = df.withColumn("score", F.col("value")).withColumn("label", F.when(F.col("value") > 7, -1).otherwise(1))
    summary = {r["series_name"]: r["results"] for r in result_rows(df, points=False).collect()}
    assert '"points":10,"anomalies":2' in summary["a"] and '"points":3,"anomalies":0' in summary["b"]
    points = result_rows(df, points_per_document=4).collect()
    assert sorted((r["series_name"], r["part"]) for r in points) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert [r["results"].count("row_key") for r in sorted(points, key=lambda r: (r["series_name"], r["part"]))] == [4, 4, 2, 3]


def test_generate(spark, limits):
    out = generate(spark, n_points=100, anomaly_ratio=0.05, n_series=2)
    rows = out.toPandas()
    assert len(rows) == 200 and rows["is_anomaly"].sum() == 10
    assert rows["ts"].min() == dt.datetime(2024, 1, 1) and rows["value"].notna().all()
    again = generate(spark, n_points=100, anomaly_ratio=0.05, n_series=2).toPandas()
    assert rows.sort_values(["series_id", "ts"])["value"].tolist() == again.sort_values(["series_id", "ts"])["value"].tolist()
    other = generate(spark, n_points=100, anomaly_ratio=0.05, n_series=2, seed=1).toPandas()
    assert other["value"].sum() != rows["value"].sum()


def test_generate_spikes_and_noise(spark):
    rows = generate(spark, n_points=2000, noise_level=1.5).select("value", "is_anomaly", clean_value(F.col("row_key")).alias("c")).toPandas()
    noise = (rows["value"] - rows["c"])[rows["is_anomaly"] == 0]
    assert abs(noise.mean()) < 0.15 and abs(noise.std() - 1.5) < 0.15
    assert (rows["value"] - rows["c"])[rows["is_anomaly"] == 1].abs().mean() > 4
    assert generate(spark, n_points=1).count() == 1


@pytest.mark.parametrize("bad", [{"n_points": 0}, {"anomaly_ratio": 0.0}, {"anomaly_ratio": 1.0}])
def test_generate_refuses(spark, bad):
    with pytest.raises(ValueError):
        generate(spark, **bad)


def test_validate(spark):
    df = spark.createDataFrame([("1", None), ("x", 2.0)], "a string, b double")
    out = {r["rule"]: r["rows"] for r in S.validate(df, ["a", "b"], ["a"]).collect()}
    assert out == {"rows": 2, "a missing": 0, "b missing": 1, "a not numeric": 1}
    with pytest.raises(ValueError):
        S.validate(df, ["c"], [])
