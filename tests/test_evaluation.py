from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions.labels import convert, is_anomaly, outside, resolve_format, threshold_side
from tideline.functions.scalars import four_decimals
from tideline.operators.ensemble import align_windows, side_by_side, strategy_table
from tideline.operators.evaluate import auc, comparison_long, confusion, counts_per_detector, evaluate, roc_curve, score_range
from tideline.operators.report import report_lines, report_rows, write_report
from tideline.operators.votes import vote, vote_all


@pytest.fixture
def verdicts(spark):
    def make(truth, labels, scores=None, detector="d"):
        scores = scores or [float(-x) for x in labels]
        rows = [(detector, i, t, p, float(s)) for i, (t, p, s) in enumerate(zip(truth, labels, scores))]
        return spark.createDataFrame(rows, "detector string, row_key int, y_true int, label int, score double")

    return make


def metrics(df, **options):
    return evaluate(df, **options).drop("detector").first().asDict()


def test_perfect_and_all_wrong(verdicts):
    perfect = metrics(verdicts([-1, -1, 1, 1, 1], [-1, -1, 1, 1, 1]))
    assert perfect == {"accuracy": 1, "precision": 1, "recall": 1, "f1": 1}
    wrong = metrics(verdicts([-1, -1, 1, 1], [1, 1, -1, -1]))
    assert wrong == {"accuracy": 0, "precision": 0, "recall": 0, "f1": 0}


def test_zero_one_truth(verdicts):
    """Without a stated format 0 is the anomaly; the data files' own format is stated."""
    df = verdicts([0, 0, 1, 1, 1], [-1, -1, 1, 1, 1])
    assert metrics(df)["accuracy"] == 1
    assert metrics(df, label_format="one_is_anomaly")["accuracy"] == 0
    assert resolve_format(verdicts([1, 1], [1, 1]), "y_true") == "zero_is_anomaly"
    with pytest.raises(ValueError):
        metrics(df, label_format="other")


def test_nothing_flagged(verdicts):
    out = metrics(verdicts([-1, 1, 1], [1, 1, 1]))
    assert out["precision"] == out["recall"] == out["f1"] == 0 and out["accuracy"] == pytest.approx(2 / 3)


def test_auc(limits, verdicts):
    df = verdicts([-1, -1, 1, 1, 1], [-1, -1, 1, 1, 1], [0.9, 0.8, 0.1, 0.2, 0.15])
    assert metrics(df, score="score")["auc_roc"] == 1
    ties = verdicts([-1, 1, -1, 1], [1, 1, 1, 1], [1, 1, 1, 1])
    assert metrics(ties, score="score")["auc_roc"] == 0.5
    single = verdicts([-1, -1], [-1, 1])
    assert metrics(single, score="score", label_format="pm1")["auc_roc"] is None


def test_auc_against_pairs(limits, verdicts):
    rng = np.random.default_rng(0)
    truth = rng.choice([-1, 1], 90, p=[0.3, 0.7])
    score = np.round(rng.normal(size=90) - 0.7 * truth, 1)
    a, n = score[truth == -1], score[truth == 1]
    want = np.mean([(x > y) + 0.5 * (x == y) for x in a for y in n])
    df = verdicts(truth.tolist(), truth.tolist(), score.tolist())
    assert auc(df).first()["auc_roc"] == pytest.approx(want)
    curve = roc_curve(df).orderBy("fpr", "tpr").toPandas()
    whole = roc_curve(df, drop_collinear=False).orderBy("fpr", "tpr").toPandas()
    assert (curve.iloc[0][["fpr", "tpr"]] == 0).all() and (curve.iloc[-1][["fpr", "tpr"]] == 1).all()
    assert len(whole) == len(np.unique(score)) + 1 and len(curve) <= len(whole)
    for points in (curve, whole):
        assert np.trapezoid(points["tpr"], points["fpr"]) == pytest.approx(want)


def test_roc_leaves_out_single_class(verdicts):
    assert roc_curve(verdicts([1, 1], [1, -1]), label_format="pm1").count() == 0


def test_confusion_keeps_empty_cells(verdicts):
    cells = confusion(verdicts([1, 1, -1], [1, 1, -1])).collect()
    assert [(r["actual"], r["predicted"], r["n"]) for r in cells] == [
        ("Normal", "Normal", 2), ("Normal", "Anomaly", 0), ("Anomaly", "Normal", 0), ("Anomaly", "Anomaly", 1)
    ]


def test_comparison(verdicts, spark):
    table = evaluate(verdicts([-1, 1], [-1, 1]).union(verdicts([-1, 1], [1, 1], detector="e")))
    assert comparison_long(table).count() == 8
    f1 = {r["detector"]: r["metric_value"] for r in comparison_long(table, metric="f1").collect()}
    assert f1 == {"d": 1.0, "e": 0.0}
    with pytest.raises(ValueError):
        comparison_long(table, metric="nope")
    with pytest.raises(ValueError):
        comparison_long(table.select("detector"))


def test_labels(spark):
    df = spark.createDataFrame([(1, -1, True), (0, 1, False)], "z int, p int, b boolean")
    out = df.select(convert("z", "one_is_anomaly"), convert("z", "zero_is_anomaly"), convert("p", "pm1"), convert("b", "bool")).collect()
    assert [tuple(r) for r in out] == [(-1, 1, -1, -1), (1, -1, 1, 1)]
    with pytest.raises(ValueError):
        is_anomaly("z", "other")
    values = spark.createDataFrame([(1.0,), (5.0,), (None,)], "v double")
    assert [r[0] for r in values.select(outside("v", F.lit(2.0), F.lit(6.0))).collect()] == [True, False, False]
    assert [r[0] for r in values.select(threshold_side("v", 5.0)).collect()] == ["normal", "above", "above"]
    assert [r[0] for r in values.select(four_decimals("v")).collect()] == ["1.0000", "5.0000", "N/A"]


def long_votes(spark, table):
    rows = [(f"d{j}", i, label) for i, row in enumerate(table) for j, label in enumerate(row)]
    return spark.createDataFrame(rows, "detector string, row_key int, label int")


def test_votes(spark):
    df = long_votes(spark, [(-1, -1, -1), (-1, -1, 1), (-1, 1, 1), (1, 1, 1), (None, -1, -1), (None, -1, 1), (None, None, None)])
    keys = ["row_key"]

    def got(strategy):
        return [r["label"] for r in vote(df, strategy, keys).orderBy("row_key").collect()]

    assert got("majority") == [-1, -1, 1, 1, -1, 1, None]
    assert got("unanimous") == [-1, 1, 1, 1, -1, 1, None]
    assert got("any") == [-1, -1, -1, 1, -1, -1, None]
    assert vote_all(df, keys).count() == 21
    with pytest.raises(ValueError):
        vote(df, "weighted", keys)


def test_two_detectors_need_both_for_a_majority(spark):
    out = vote(long_votes(spark, [(-1, 1), (-1, -1)]), "majority", ["row_key"]).orderBy("row_key").collect()
    assert [r["label"] for r in out] == [1, -1]


def test_strategy_table(spark):
    df = long_votes(spark, [(-1, -1), (-1, 1), (1, 1)]).withColumn("y_true", F.when(F.col("row_key") < 2, -1).otherwise(1))
    out = {r["strategy"]: r["recall"] for r in strategy_table(df, keys=["row_key"]).collect()}
    assert out == {"majority": 0.5, "unanimous": 0.5, "any": 1.0}


def test_alignment(spark):
    df = long_votes(spark, [(-1, 1), (1, None)])
    assert [tuple(r) for r in side_by_side(df, ["d0", "d1"], ["row_key"]).orderBy("row_key").collect()] == [(0, -1, 1), (1, 1, None)]
    rows = spark.range(3).select(F.col("id").cast("int").alias("row_key"))
    out = align_windows(rows, df.where("detector = 'd0'").select("row_key", "label"), ["row_key"]).orderBy("row_key")
    assert [r["label"] for r in out.collect()] == [-1, 1, None]


def test_score_range(limits, verdicts):
    out = score_range(verdicts([1] * 7, [1] * 7, list(range(7))), ["detector"]).orderBy("row_key").toPandas()
    np.testing.assert_allclose(out["score_scaled"], np.arange(7) / 6, atol=1e-9)


def test_report(spark, verdicts, tmp_path):
    labels = [-1] * 10 + [1] * 90
    other = [-1] * 15 + [1] * 85
    df = verdicts(labels, labels).union(verdicts(labels, other, detector="e"))
    rows = report_rows(df, evaluate(df), ["row_key"])
    text = "\n".join(r["line"] for r in report_lines(rows).orderBy("line_no").collect())
    for part in (
        "100 rows were judged by 2 detectors.", "| d | 10 | 10.00% | 1.0000 | 1.0000 | 1.0000 | 1.0000 | N/A |", "| e | 15 | 15.00% |",
        "more than half of the detectors: 10 rows", "every detector: 10 rows",
    ):
        assert part in text
    plain = report_rows(df, None, ["row_key"])
    assert plain.where("section = 'metrics'").count() == 0
    assert "| d | 10 | 10.00% | N/A | N/A | N/A | N/A | N/A |" in [r["line"] for r in report_lines(plain).collect()]
    write_report(rows, str(tmp_path / "report"))
    assert "\n".join(r[0] for r in spark.read.text(str(tmp_path / "report")).collect()) == text
    with pytest.raises(ValueError):
        report_lines(rows.where("false"))
    assert {r["detector"]: r["pct"] for r in counts_per_detector(df).collect()} == {"d": 10, "e": 15}
