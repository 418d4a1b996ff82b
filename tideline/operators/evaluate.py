"""Comparing verdicts with the ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from tideline.functions.labels import is_anomaly, resolve_format, to_label
from tideline.plans import Running, attach, framed, freeze, rows_of, scan
from tideline.plans.attach import join_null_safe

METRICS = ("accuracy", "precision", "recall", "f1", "auc_roc")


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def evaluate(
    df: DataFrame,
    truth: str = "y_true",
    label: str = "label",
    score: str | None = None,
    by: Sequence[str] = ("detector",),
    label_format: str = "auto",
) -> DataFrame:
    """Accuracy, precision, recall and F1 with the anomaly as the positive class.

    With ``score`` the area under the ROC curve is added, null where the truth has one class.
    Rows without a verdict do not count.
    """
    by = list(by)
    label_format = resolve_format(df, truth, label_format)
    actual, flagged = is_anomaly(truth, label_format), F.col(label) == -1
    counts = (
        df.where(F.col(label).isNotNull() & F.col(truth).isNotNull())
        .groupBy(*by)
        .agg(
            F.count_if(actual & flagged).alias("_tp"),
            F.count_if(~actual & flagged).alias("_fp"),
            F.count_if(actual & ~flagged).alias("_fn"),
            F.count_if(~actual & ~flagged).alias("_tn"),
        )
    )
    tp, fp, fn, tn = (F.col(c) for c in ("_tp", "_fp", "_fn", "_tn"))
    out = counts.select(
        *by,
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    if score is None:
        return out
    return attach(out, auc(df, truth, score, by, label_format), by, how="left")


def _per_score(df: DataFrame, truth: str, score: str, by: Sequence[str], label_format: str) -> DataFrame:
    """Anomalies and normal rows per distinct score: everything a ROC curve depends on."""
    actual = is_anomaly(truth, label_format)
    counted = (
        df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
        .groupBy(*by, F.col(score).alias("_score"))
        .agg(F.count_if(actual).alias("_pos"), F.count_if(~actual).alias("_neg"))
    )
    return freeze(counted, "scores")


def auc(
    df: DataFrame,
    truth: str = "y_true",
    score: str = "score",
    by: Sequence[str] = ("detector",),
    label_format: str = "auto",
) -> DataFrame:
    """Exact area under the ROC curve: the share of (anomaly, normal) pairs in the right order."""
    by = list(by)
    label_format = resolve_format(df, truth, label_format)
    counts = _per_score(df, truth, score, by, label_format)
    ranked = scan(counts, by, ["_score"], [Running(F.col("_neg"), "_below", inclusive=False)])
    pairs = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    return ranked.groupBy(*by).agg(
        F.try_divide(pairs, F.sum("_pos") * F.sum("_neg").cast("double")).alias("auc_roc")
    )


def roc_curve(
    df: DataFrame,
    truth: str = "y_true",
    score: str = "score",
    by: Sequence[str] = ("detector",),
    label_format: str = "auto",
    drop_collinear: bool = True,
) -> DataFrame:
    """Points ``(fpr, tpr, threshold)`` of each curve from (0, 0); groups of one class are left out."""
    by = list(by)
    label_format = resolve_format(df, truth, label_format)
    counts = _per_score(df, truth, score, by, label_format)
    totals = counts.groupBy(*by).agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    totals = freeze(totals.where((F.col("_p") > 0) & (F.col("_n") > 0)), "totals")
    falling = counts.withColumn("_desc", -F.col("_score"))
    size = rows_of(counts)
    points = scan(falling, by, ["_desc"], [Running(F.col("_pos"), "_tps"), Running(F.col("_neg"), "_fps")], size)
    points = points.select(*by, "_desc", "_score", "_tps", "_fps")
    if drop_collinear:

        def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
            bends = [
                F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w) for c in ("_tps", "_fps")
            ]
            # The ends have no second difference and are kept.
            keep = F.coalesce((bends[0] != 0) | (bends[1] != 0), F.lit(True))
            return rows.select("*", keep.alias("_keep"))

        points = framed(points, by, ["_desc"], 1, 1, build, size).where("_keep")
    curve = attach(points, totals, by, frozen=True).select(
        *by,
        (F.col("_fps") / F.col("_n")).alias("fpr"),
        (F.col("_tps") / F.col("_p")).alias("tpr"),
        F.col("_score").alias("threshold"),
    )
    origin = totals.select(*by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return origin.unionByName(curve)


def confusion(
    df: DataFrame,
    truth: str = "y_true",
    label: str = "label",
    by: Sequence[str] = ("detector",),
    label_format: str = "auto",
) -> DataFrame:
    """The four cells per group in the order normal, anomaly; empty cells are kept."""
    label_format = resolve_format(df, truth, label_format)
    actual, flagged = is_anomaly(truth, label_format), F.col(label) == -1
    cells = [("Normal", ~actual, "Normal", ~flagged), ("Normal", ~actual, "Anomaly", flagged),
             ("Anomaly", actual, "Normal", ~flagged), ("Anomaly", actual, "Anomaly", flagged)]
    counts = df.groupBy(*by).agg(*[F.count_if(a & p).alias(f"_c{k}") for k, (_, a, _, p) in enumerate(cells)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"_c{k}").alias("n"))
            for k, (a, _, p, _) in enumerate(cells)
        ]
    )
    return counts.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def comparison_long(metrics: DataFrame, by: Sequence[str] = ("detector",), metric: str | None = None) -> DataFrame:
    """The comparison table with one row per metric, or a single metric of it."""
    present = [m for m in METRICS if m in metrics.columns]
    if not present:
        raise ValueError("no metrics available; evaluate with ground truth first")
    if metric is not None and metric not in present:
        raise ValueError(f"metric {metric!r} not available; choose from {present}")
    return metrics.unpivot(list(by), [metric] if metric else present, "metric", "metric_value")


def counts_per_detector(results: DataFrame, by: Sequence[str] = ("detector",)) -> DataFrame:
    """Anomalies found and their share in percent."""
    found = F.count_if(F.col("label") == -1)
    return results.groupBy(*by).agg(
        found.alias("anomalies"),
        F.count("label").alias("points"),
        _ratio(found * F.lit(100.0), F.count("label")).alias("pct"),
    )


def attach_truth(
    results: DataFrame, truth: DataFrame, column: str, label_format: str, keys: Sequence[str], name: str = "y_true"
) -> DataFrame:
    """Bring the ground truth to the results by key, as −1/1; rows without truth stay, unlabelled."""
    flags = truth.select(*keys, to_label(is_anomaly(column, label_format)).alias(name))
    return join_null_safe(results, flags, list(keys), how="left")


def score_range(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``score_scaled``: the score of each group brought to [0, 1]."""
    by = list(by)
    span = results.groupBy(*by).agg(F.min("score").alias("_min"), F.max("score").alias("_max"))
    out = attach(results, span, by)
    # Fixed value: 1e-10 keeps a constant score from dividing by zero.
    scaled = (F.col("score") - F.col("_min")) / (F.col("_max") - F.col("_min") + F.lit(1e-10))
    return out.withColumn("score_scaled", scaled).drop("_min", "_max")
