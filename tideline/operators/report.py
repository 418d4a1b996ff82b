"""The detection report, as rows and as Markdown lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.scalars import four_decimals
from tideline.operators.evaluate import METRICS, counts_per_detector
from tideline.operators.votes import tally
from tideline.sources.series import KEY, SERIES, TS


def report_rows(
    results: DataFrame,
    metrics: DataFrame | None = None,
    keys: Sequence[str] = (SERIES, TS, KEY),
    votes: DataFrame | None = None,
) -> DataFrame:
    """Everything the report states, as ``(section, item, entry, value)``.

    Sections: ``summary``, ``metrics`` and ``details`` per detector, ``ensemble``. ``votes`` is the
    tally of the results where the caller has it already.
    """
    per_detector = counts_per_detector(results)

    def entries(section: Column, item: Column, **values: Column) -> Column:
        return F.array(
            *[
                F.struct(section.alias("section"), item.alias("item"), F.lit(k).alias("entry"), v.cast("string").alias("value"))
                for k, v in values.items()
            ]
        )

    detector = F.col("detector")
    details = per_detector.select(
        F.explode(
            F.concat(
                entries(F.lit("summary"), detector, anomalies=F.col("anomalies")),
                entries(F.lit("details"), detector, anomalies=F.col("anomalies"), pct=F.format_string("%.2f%%", F.col("pct"))),
            )
        ).alias("_r")
    ).select("_r.*")
    run = per_detector.agg(F.count(F.lit(1)).alias("detectors"), F.max("points").alias("points"))
    summary = run.select(
        F.explode(entries(F.lit("summary"), F.lit("all"), detectors_run=F.col("detectors"), total_points=F.col("points"))).alias("_r")
    ).select("_r.*")
    n_votes, n_voters = F.col("votes"), F.col("voters")
    agreed = (tally(results, keys) if votes is None else votes).agg(
        F.count_if(2 * n_votes > n_voters).alias("majority"),
        F.count_if((n_votes == n_voters) & (n_voters > 0)).alias("unanimous"),
    )
    ensemble = agreed.select(
        F.explode(entries(F.lit("ensemble"), F.lit("all"), majority=F.col("majority"), unanimous=F.col("unanimous"))).alias("_r")
    ).select("_r.*")
    out = summary.unionByName(details).unionByName(ensemble)
    if metrics is None:
        return out
    named = [m if m in metrics.columns else None for m in METRICS]
    cells = {m: four_decimals(F.col(m)) if found else F.lit("N/A") for m, found in zip(METRICS, named)}
    table = metrics.select(F.explode(entries(F.lit("metrics"), detector, **cells)).alias("_r")).select("_r.*")
    return out.unionByName(table)


def report_lines(rows: DataFrame, title: str = "Detection Report") -> DataFrame:
    """Markdown ``(line_no, line)`` from report rows; their number depends on the detectors only."""
    found = rows.orderBy("section", "item", "entry").collect()
    value = {(r["section"], r["item"], r["entry"]): r["value"] for r in found}
    detectors = sorted({r["item"] for r in found if r["section"] == "details"})
    if not detectors:
        raise ValueError("nothing to report")
    n = value["summary", "all", "detectors_run"]
    lines = [f"# {title}", "", f"{value['summary', 'all', 'total_points']} rows were judged by {n} detectors.", ""]
    lines += ["| Detector | Flagged | Share | " + " | ".join(METRICS) + " |", "| --- " * (len(METRICS) + 3) + "|"]
    for d in detectors:
        measures = [value.get(("metrics", d, m), "N/A") for m in METRICS]
        lines += ["| " + " | ".join([d, value["details", d, "anomalies"], value["details", d, "pct"], *measures]) + " |"]
    lines += ["", f"Flagged by more than half of the detectors: {value['ensemble', 'all', 'majority']} rows."]
    lines += [f"Flagged by every detector: {value['ensemble', 'all', 'unanimous']} rows.", ""]
    return rows.sparkSession.createDataFrame(list(enumerate(lines)), "line_no int, line string")


def write_report(rows: DataFrame, path: str, title: str = "Detection Report") -> None:
    """Write the Markdown report as one text file in the folder ``path``."""
    lines = report_lines(rows, title)
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)
