"""Running several detectors and combining their verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.labels import ANOMALY, is_anomaly, resolve_format, to_label
from tideline.operators.detector import OUTPUT, Detector, DetectorModel
from tideline.operators.evaluate import comparison_long, evaluate
from tideline.operators.report import report_rows
from tideline.operators.votes import check_strategy, decide, vote_all
from tideline.plans import freeze
from tideline.plans.attach import join_null_safe
from tideline.sources.series import KEY, SERIES, TS


def strategy_table(
    results: DataFrame, truth: str = "y_true", keys: Sequence[str] = (SERIES, TS, KEY), label_format: str = "auto"
) -> DataFrame:
    """Metrics of each strategy, on results that carry the truth."""
    return evaluate(vote_all(results, [*keys, truth]), truth, "label", None, ["strategy"], label_format)


def side_by_side(
    results: DataFrame, detectors: Sequence[str], keys: Sequence[str] = (SERIES, TS, KEY), value: str = "label"
) -> DataFrame:
    """One column per detector."""
    return results.groupBy(*keys).pivot("detector", list(detectors)).agg(F.first(value))


def align_windows(
    series: DataFrame, windowed: DataFrame, keys: Sequence[str] = (SERIES, TS, KEY)
) -> DataFrame:
    """Put window results on the row that ends the window; rows before the first window stay null."""
    return join_null_safe(series, windowed, list(keys), how="left")


class Ensemble:
    """A set of detectors run on the same series."""

    def __init__(self, detectors: Sequence[Detector] = (), by: Sequence[str] = (SERIES,), order: Sequence[str] = (TS, KEY)):
        self.by, self.order = list(by), list(order)
        self.detectors: dict[str, Detector] = {}
        self.models: dict[str, DetectorModel] = {}
        self.wide: DataFrame | None = None
        self.results: DataFrame | None = None
        self.metrics: DataFrame | None = None
        for d in detectors:
            self.add(d)

    def add(self, detector: Detector) -> None:
        if detector.name in self.detectors:
            raise ValueError(f"a detector named {detector.name!r} is already registered")
        self.detectors[detector.name] = detector

    @property
    def keys(self) -> list[str]:
        return [*self.by, *self.order]

    def run(self, df: DataFrame, truth: str | None = None, label_format: str = "auto") -> DataFrame:
        """Fit every detector, then score: one row per row and detector, plus the truth if given.

        Detectors that score single rows add their verdicts side by side in one pass; only those
        that score windows are joined, on the row that ends the window.
        """
        if not self.detectors:
            raise ValueError("no detectors registered")
        known = []
        if truth is not None:
            label_format = resolve_format(df, truth, label_format)
            known = [to_label(is_anomaly(truth, label_format)).alias("_truth")]
        # What the detectors read is taken from the source once; the truth is settled before any of them writes.
        needed = dict.fromkeys([*self.keys, *(c for d in self.detectors.values() for c in (*d.by, *d.order, *d.inputs))])
        rows = freeze(df.select(*needed, *known), "rows")
        self.models = {n: d.fit(rows) for n, d in self.detectors.items()}
        places = {n: f"_verdict{i}" for i, n in enumerate(self.models)}
        if not all(m.keeps_rows for m in self.models.values()):
            self._check_keys(rows)
        wide = rows
        for name, model in sorted(self.models.items(), key=lambda item: not item[1].keeps_rows):
            if model.keeps_rows:
                wide = model.verdict(wide, places[name])
            else:
                windows = model.transform(rows).select(*self.keys, F.struct(*OUTPUT).alias(places[name]))
                wide = align_windows(wide, windows, self.keys)
        named = [] if truth is None else [F.col("_truth").alias("y_true")]
        self.wide = freeze(wide.select(*self.keys, *named, *places.values()), "verdicts")
        self.results = self._long(places, [] if truth is None else ["y_true"])
        self.metrics = None
        if truth is not None:
            self.metrics = freeze(evaluate(self.results, score="score", label_format="pm1"), "metrics")
        return self.results

    def _check_keys(self, rows: DataFrame) -> None:
        """Windows meet rows by key, so keys that occur twice would multiply them."""
        twice = rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not twice.isEmpty():
            raise ValueError(f"rows share the keys {self.keys}; name a unique key column")

    def _long(self, places: dict[str, str], known: list[str]) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(n).alias("detector"), F.col(c).alias("v")) for n, c in places.items()])
        rows = self.wide.select(*self.keys, *known, F.explode(entries).alias("_e")).where("_e.v IS NOT NULL")
        return rows.select(*self.keys, *known, "_e.detector", "_e.v.*")

    def _done(self) -> DataFrame:
        if self.results is None:
            raise ValueError("no results available; call run first")
        return self.results

    def compare(self, metric: str | None = None) -> DataFrame:
        self._done()
        if self.metrics is None:
            raise ValueError("no metrics available; run with ground truth first")
        return self.metrics if metric is None else comparison_long(self.metrics, metric=metric)

    def tally(self) -> DataFrame:
        """Votes and verdicts per row, read off the verdicts side by side."""
        self._done()
        labels = [F.col(f"_verdict{i}.label") for i in range(len(self.models))]
        votes = sum((F.when(c == ANOMALY, 1).otherwise(0) for c in labels), F.lit(0).cast("long"))
        voters = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in labels), F.lit(0).cast("long"))
        return self.wide.select(*self.keys, votes.alias("votes"), voters.alias("voters"))

    def vote(self, strategy: str = "majority") -> DataFrame:
        check_strategy(strategy)
        return self.tally().withColumn("label", decide(F.col("votes"), F.col("voters"), strategy))

    def report(self) -> DataFrame:
        """Report rows of the run."""
        return report_rows(self._done(), self.metrics, votes=self.tally())
