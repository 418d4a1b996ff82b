"""Metrics, curves, votes and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.inputs import DOCUMENTS, EVENTS, documents_scored, events
from catalog.preparation import BAND
from catalog.registry import query
from tideline.functions.labels import ANOMALY, convert, threshold_side, to_label
from tideline.functions.scalars import four_decimals
from tideline.operators.ensemble import align_windows, side_by_side, strategy_table
from tideline.operators.evaluate import (
    attach_truth,
    auc,
    comparison_long,
    confusion,
    counts_per_detector,
    evaluate,
    roc_curve,
    score_range,
)
from tideline.operators.profile import flag_fliers
from tideline.operators.report import report_lines, report_rows
from tideline.operators.rolling import rolling_band
from tideline.operators.scaling import normalize
from tideline.operators.votes import vote, vote_all
from tideline.plans import freeze, quantiles
from tideline.plans.attach import attach

METRIC_NAMES = ("accuracy", "precision", "recall", "f1", "auc_roc")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in METRIC_NAMES if c in df.columns})


def metrics_sql(rows: str, group: str, anomaly: str) -> str:
    """Metrics per group from rows with a label and a truth condition."""
    return f"""SELECT {group}, count(*) FILTER (WHERE ({anomaly}) = (label = -1)) / count(*) AS accuracy,
        coalesce(count(*) FILTER (WHERE ({anomaly}) AND label = -1) / nullif(count(*) FILTER (WHERE label = -1), 0), 0) AS precision,
        coalesce(count(*) FILTER (WHERE ({anomaly}) AND label = -1) / nullif(count(*) FILTER (WHERE {anomaly}), 0), 0) AS recall,
        coalesce(2 * count(*) FILTER (WHERE ({anomaly}) AND label = -1)
            / nullif(count(*) FILTER (WHERE label = -1) + count(*) FILTER (WHERE {anomaly}), 0), 0) AS f1
    FROM {rows} WHERE label IS NOT NULL GROUP BY {group}"""


def auc_sql(rows: str, anomaly: str) -> str:
    """Area under the curve from the ranks of the anomalies' scores, ties sharing a rank."""
    return f"""SELECT detector, (sum(r) FILTER (WHERE a) - np * (np + 1) / 2) / (np * nn) AS auc_roc FROM (
        SELECT detector, ({anomaly}) AS a,
            rank() OVER (PARTITION BY detector ORDER BY score)
                + (count(*) OVER (PARTITION BY detector, score) - 1) / 2 AS r,
            count(*) FILTER (WHERE {anomaly}) OVER (PARTITION BY detector) AS np,
            count(*) FILTER (WHERE NOT ({anomaly})) OVER (PARTITION BY detector) AS nn
        FROM {rows}) GROUP BY detector, np, nn"""


_TOXIC_METRICS = f"WITH {DOCUMENTS}, m AS ({metrics_sql('x', 'detector', 'toxic = 1')}), u AS ({auc_sql('x', 'toxic = 1')})"


@query(
    f"""WITH {DOCUMENTS}, m AS ({metrics_sql('x', 'detector', 'quality = 0')})
    SELECT detector, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(f1, 6) AS f1 FROM m"""
)
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """0/1 truth without a stated format: 0 is the anomaly."""
    return _rounded(evaluate(documents_scored(spark, sf), "quality"))


@query(f"WITH {DOCUMENTS}, u AS ({auc_sql('x', 'toxic = 1')}) SELECT detector, round(auc_roc, 6) AS auc_roc FROM u")
def eval_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(auc(documents_scored(spark, sf), "toxic", label_format="one_is_anomaly"))


_POINTS = f"""WITH {DOCUMENTS}, g AS (SELECT detector, score, count(*) FILTER (WHERE toxic = 1) AS p,
        count(*) FILTER (WHERE toxic = 0) AS n FROM x GROUP BY 1, 2),
    r AS (SELECT detector, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp,
        sum(p) OVER (PARTITION BY detector) AS np, sum(n) OVER (PARTITION BY detector) AS nn
        FROM g WINDOW w AS (PARTITION BY detector ORDER BY score DESC))"""


@query(
    _POINTS
    + """SELECT detector, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr, score AS threshold FROM r
    UNION ALL SELECT DISTINCT detector, 0.0, 0.0, NULL FROM r"""
)
def eval_roc(spark: SparkSession, sf: str) -> DataFrame:
    out = roc_curve(documents_scored(spark, sf), "toxic", label_format="one_is_anomaly", drop_collinear=False)
    return out.withColumns({"fpr": F.round("fpr", 6), "tpr": F.round("tpr", 6)})


@query(
    _POINTS
    + """, k AS (SELECT *, lead(tp) OVER w - 2 * tp + lag(tp) OVER w AS bp, lead(fp) OVER w - 2 * fp + lag(fp) OVER w AS bn
        FROM r WINDOW w AS (PARTITION BY detector ORDER BY score DESC))
    SELECT detector, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr, score AS threshold FROM k
    WHERE bp IS NULL OR bn IS NULL OR bp <> 0 OR bn <> 0
    UNION ALL SELECT DISTINCT detector, 0.0, 0.0, NULL FROM r"""
)
def eval_roc_corners(spark: SparkSession, sf: str) -> DataFrame:
    out = roc_curve(documents_scored(spark, sf), "toxic", label_format="one_is_anomaly")
    return out.withColumns({"fpr": F.round("fpr", 6), "tpr": F.round("tpr", 6)})


@query(
    f"""WITH {DOCUMENTS}, c AS (SELECT detector, a.actual, p.predicted FROM (SELECT DISTINCT detector FROM x),
        (VALUES ('Normal'), ('Anomaly')) a(actual), (VALUES ('Normal'), ('Anomaly')) p(predicted))
    SELECT c.detector, c.actual, c.predicted, count(x.doc_id) AS n FROM c LEFT JOIN x ON x.detector = c.detector
        AND (x.toxic = 1) = (c.actual = 'Anomaly') AND (x.label = -1) = (c.predicted = 'Anomaly')
    GROUP BY 1, 2, 3"""
)
def eval_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return confusion(documents_scored(spark, sf), "toxic", label_format="one_is_anomaly")


@query(
    _TOXIC_METRICS
    + """SELECT detector, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(f1, 6) AS f1, round(auc_roc, 6) AS auc_roc FROM m JOIN u USING (detector)"""
)
def eval_table(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate(documents_scored(spark, sf), "toxic", score="score", label_format="one_is_anomaly"))


@query(
    _TOXIC_METRICS
    + """, t AS (SELECT * FROM m JOIN u USING (detector)),
    l AS (SELECT detector, 'accuracy' AS metric, accuracy AS x FROM t UNION ALL SELECT detector, 'precision', precision FROM t
        UNION ALL SELECT detector, 'recall', recall FROM t UNION ALL SELECT detector, 'f1', f1 FROM t
        UNION ALL SELECT detector, 'auc_roc', auc_roc FROM t)
    SELECT detector, metric, format('{:.4f}', x) AS shown FROM l"""
)
def eval_table_long(spark: SparkSession, sf: str) -> DataFrame:
    table = evaluate(documents_scored(spark, sf), "toxic", score="score", label_format="one_is_anomaly")
    return comparison_long(table).select("detector", "metric", four_decimals("metric_value").alias("shown"))


@query(
    f"""WITH {DOCUMENTS} SELECT detector, count(*) FILTER (WHERE label = -1) AS anomalies, count(*) AS points,
        round(count(*) FILTER (WHERE label = -1) * 100.0 / count(*), 6) AS pct FROM x GROUP BY detector"""
)
def detector_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts_per_detector(documents_scored(spark, sf)).withColumn("pct", F.round("pct", 6))


@query(
    """SELECT doc_id, CASE WHEN quality = 0 THEN -1 ELSE 1 END AS quality_label,
        CASE WHEN toxic = 1 THEN -1 ELSE 1 END AS toxic_label FROM labels"""
)
def label_conversion(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/labels.parquet")
    return rows.select(
        "doc_id",
        convert("quality", "zero_is_anomaly").alias("quality_label"),
        convert("toxic", "one_is_anomaly").alias("toxic_label"),
    )


# Three plain detectors on the events: leaving the rolling band (no verdict before the first full
# window), lying outside the whiskers, and lying more than two deviations from the mean.


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    keys = ["series_id", "ts", "row_key"]
    band = rolling_band(rows)
    inside = F.when(F.col("rolling_mean").isNotNull(), F.col("outside_band"))
    distance = F.abs(F.col("value") - F.col("rolling_mean")) / F.col("rolling_std")
    parts = [band.select(*keys, F.lit("band").alias("detector"), distance.alias("score"), to_label(inside).alias("label"))]
    boxed = flag_fliers(rows)
    parts.append(boxed.select(*keys, F.lit("box").alias("detector"), F.col("value").alias("score"), to_label(F.col("flier")).alias("label")))
    scaled, _ = normalize(rows, ["value"])
    z = F.abs("value")
    parts.append(scaled.select(*keys, F.lit("sigma").alias("detector"), z.alias("score"), to_label(z > 2).alias("label")))
    return reduce(DataFrame.unionByName, parts)


VERDICTS = f"""{EVENTS}, {BAND.format('e')},
    q AS (SELECT s, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, avg(v) AS m, stddev_pop(v) AS sd FROM e GROUP BY s),
    x AS (SELECT s, ts, k, 'band' AS detector, abs(v - m) / sd AS score,
            CASE WHEN v < lo OR v > hi THEN -1 WHEN m IS NOT NULL THEN 1 END AS label FROM b
        UNION ALL SELECT s, ts, k, 'box', v, CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN -1 ELSE 1 END
            FROM e JOIN q USING (s)
        UNION ALL SELECT s, ts, k, 'sigma', abs((v - m) / sd), CASE WHEN abs((v - m) / sd) > 2 THEN -1 ELSE 1 END
            FROM e JOIN q USING (s)),
    t AS (SELECT s, ts, k, count(*) FILTER (WHERE label = -1) AS votes, count(label) AS voters FROM x GROUP BY 1, 2, 3)"""


def _vote(strategy: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return vote(verdicts(spark, sf), strategy)

    return run


_RULES = {"majority": "2 * votes > voters", "unanimous": "votes = voters", "any": "votes > 0"}


def _vote_sql(strategy: str) -> str:
    return f"""WITH {VERDICTS} SELECT s AS series_id, ts, k AS row_key, votes, voters,
        CASE WHEN {_RULES[strategy]} THEN -1 ELSE 1 END AS label FROM t"""


@query(_vote_sql("majority"))
def vote_majority(spark: SparkSession, sf: str) -> DataFrame:
    return _vote("majority")(spark, sf)


@query(_vote_sql("unanimous"))
def vote_unanimous(spark: SparkSession, sf: str) -> DataFrame:
    return _vote("unanimous")(spark, sf)


@query(_vote_sql("any"))
def vote_any(spark: SparkSession, sf: str) -> DataFrame:
    return _vote("any")(spark, sf)


_STRATEGIES = " UNION ALL ".join(
    f"SELECT s, ts, k, '{n}' AS strategy, CASE WHEN {r} THEN -1 ELSE 1 END AS label FROM t" for n, r in _RULES.items()
)


@query(
    f"""WITH {VERDICTS}, st AS ({_STRATEGIES})
    SELECT s AS series_id, strategy, count(*) FILTER (WHERE label = -1) AS anomalies FROM st GROUP BY 1, 2"""
)
def vote_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vote_all(verdicts(spark, sf)).groupBy("series_id", "strategy").agg(F.count_if(F.col("label") == -1).alias("anomalies"))


@query(
    f"""WITH {VERDICTS}, st AS ({_STRATEGIES}), j AS (SELECT st.*, props LIKE '%"k": 1%' AS a FROM st JOIN events ON event_id = k),
    m AS ({metrics_sql('j', 'strategy', 'a')})
    SELECT strategy, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(f1, 6) AS f1 FROM m"""
)
def vote_table(spark: SparkSession, sf: str) -> DataFrame:
    truth = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("row_key"), F.col("props").contains('"k": 1').alias("odd")
    )
    labelled = attach_truth(verdicts(spark, sf), truth, "odd", "bool", ["row_key"])
    return _rounded(strategy_table(labelled, label_format="pm1"))


@query(
    f"""WITH {VERDICTS} SELECT s AS series_id, ts, k AS row_key,
        coalesce(max(label) FILTER (WHERE detector = 'band'), 0) AS band, max(label) FILTER (WHERE detector = 'box') AS box, max(label) FILTER (WHERE detector = 'sigma') AS sigma
    FROM x GROUP BY 1, 2, 3"""
)
def side_by_side_labels(spark: SparkSession, sf: str) -> DataFrame:
    """0 stands for no verdict."""
    return side_by_side(verdicts(spark, sf), ["band", "box", "sigma"]).na.fill(0, ["band"])


@query(
    f"""WITH {VERDICTS}, w AS (SELECT s, ts, k, label FROM x WHERE detector = 'band' AND label IS NOT NULL)
    SELECT e.s AS series_id, e.ts, e.k AS row_key, e.v AS value, coalesce(w.label, 0) AS label FROM e LEFT JOIN w ON e.s = w.s AND e.ts = w.ts AND e.k = w.k"""
)
def align_window_ends(spark: SparkSession, sf: str) -> DataFrame:
    windowed = verdicts(spark, sf).where("detector = 'band' AND label IS NOT NULL")
    out = align_windows(events(spark, sf), windowed.select("series_id", "ts", "row_key", "label"))
    return out.na.fill(0, ["label"])


@query(
    f"""WITH {EVENTS}, p AS (SELECT s, quantile_cont(v, 0.95) AS t FROM e GROUP BY s)
    SELECT s AS series_id, CASE WHEN v < t THEN 'normal' ELSE 'above' END AS side, count(*) AS n, round(sum(v), 4) AS total
    FROM e JOIN p USING (s) GROUP BY 1, 2"""
)
def threshold_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    cut = quantiles(rows, ["series_id"], "value", {"threshold": 0.95})
    sides = attach(rows, cut, ["series_id"]).withColumn("side", threshold_side("value", F.col("threshold")))
    return sides.groupBy("series_id", "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    f"""WITH {VERDICTS}, r AS (SELECT s, detector, min(score) AS a, max(score) AS b FROM x GROUP BY 1, 2)
    SELECT x.s AS series_id, x.ts, x.k AS row_key, x.detector, round((score - a) / (b - a + 1e-10), 6) AS score_scaled
    FROM x JOIN r ON x.s = r.s AND x.detector = r.detector"""
)
def score_minmax(spark: SparkSession, sf: str) -> DataFrame:
    out = score_range(verdicts(spark, sf), ["series_id", "detector"])
    return out.select("series_id", "ts", "row_key", "detector", F.round("score_scaled", 6).alias("score_scaled"))


@query(f"WITH {VERDICTS} SELECT s AS series_id, ts, k AS row_key, detector FROM x WHERE label = -1")
def overlay_points(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).where(F.col("label") == ANOMALY).select("series_id", "ts", "row_key", "detector")


@query(
    f"""WITH {VERDICTS}, c AS (SELECT detector, count(*) FILTER (WHERE label = -1) AS a, count(label) AS n FROM x GROUP BY 1)
    SELECT 'summary' AS section, 'all' AS item, 'detectors_run' AS entry, CAST(count(*) AS VARCHAR) AS value FROM c
    UNION ALL SELECT 'summary', 'all', 'total_points', CAST(max(n) AS VARCHAR) FROM c
    UNION ALL SELECT 'summary', detector, 'anomalies', CAST(a AS VARCHAR) FROM c
    UNION ALL SELECT 'details', detector, 'anomalies', CAST(a AS VARCHAR) FROM c
    UNION ALL SELECT 'details', detector, 'pct', format('{{:.2f}}%', a * 100.0 / n) FROM c
    UNION ALL SELECT 'ensemble', 'all', 'majority', CAST(count(*) FILTER (WHERE 2 * votes > voters) AS VARCHAR) FROM t
    UNION ALL SELECT 'ensemble', 'all', 'unanimous', CAST(count(*) FILTER (WHERE votes = voters) AS VARCHAR) FROM t"""
)
def report_facts(spark: SparkSession, sf: str) -> DataFrame:
    return report_rows(verdicts(spark, sf))


@query(
    _TOXIC_METRICS
    + """, c AS (SELECT detector, count(*) FILTER (WHERE label = -1) AS a, count(label) AS n FROM x GROUP BY 1),
    t AS (SELECT doc_id, count(*) FILTER (WHERE label = -1) AS votes, count(label) AS voters FROM x GROUP BY 1),
    k AS (SELECT max(n) AS n, count(*) AS d FROM c)
    SELECT 0 AS line_no, '# Detection Report' AS line
    UNION ALL SELECT unnest([1, 3]), ''
    UNION ALL SELECT 2, format('{} rows were judged by {} detectors.', n, d) FROM k
    UNION ALL SELECT 4, '| Detector | Flagged | Share | accuracy | precision | recall | f1 | auc_roc |'
    UNION ALL SELECT 5, '| --- | --- | --- | --- | --- | --- | --- | --- |'
    UNION ALL SELECT CAST(5 + row_number() OVER (ORDER BY detector) AS INT), format('| {} | {} | {:.2f}% | {:.4f} | {:.4f} | {:.4f} | {:.4f} | {:.4f} |',
        detector, a, a * 100.0 / n, accuracy, precision, recall, f1, auc_roc) FROM c JOIN m USING (detector) JOIN u USING (detector)
    UNION ALL SELECT CAST(6 + d AS INT), '' FROM k
    UNION ALL SELECT CAST(7 + d AS INT), format('Flagged by more than half of the detectors: {} rows.',
        (SELECT count(*) FROM t WHERE 2 * votes > voters)) FROM k
    UNION ALL SELECT CAST(8 + d AS INT), format('Flagged by every detector: {} rows.', (SELECT count(*) FROM t WHERE votes = voters)) FROM k
    UNION ALL SELECT CAST(9 + d AS INT), '' FROM k"""
)
def report_markdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents_scored(spark, sf)
    metrics = evaluate(rows, "toxic", score="score", label_format="one_is_anomaly")
    return report_lines(freeze(report_rows(rows, metrics, keys=["doc_id"]), "report"))
