"""What every detector offers, and how thresholds turn scores into labels."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.labels import to_label
from tideline.sources.series import KEY, SERIES, TS

OUTPUT = ("raw_score", "threshold", "score", "label")


class Detector(ABC):
    """A detector to be fitted. Higher scores are more anomalous; −1 marks an anomaly.

    ``inputs`` are numeric columns, or one array column holding the vector of a row.
    A detector of one's own implements ``fit`` here and ``transform`` in its model.
    """

    def __init__(
        self,
        name: str,
        inputs: Sequence[str] | str = ("value",),
        by: Sequence[str] = (SERIES,),
        order: Sequence[str] = (TS, KEY),
    ) -> None:
        self.name = name
        self.inputs = (inputs,) if isinstance(inputs, str) else tuple(inputs)
        self.by, self.order = list(by), list(order)

    @abstractmethod
    def fit(self, df: DataFrame) -> DetectorModel: ...

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def vector(self, df: DataFrame) -> Column:
        """The row as an array of doubles; null if any part is missing."""
        if self.is_array(df):
            return F.col(self.inputs[0]).cast("array<double>")
        whole = F.lit(True)
        for c in self.inputs:
            whole = whole & F.col(c).isNotNull()
        return F.when(whole, F.array(*[F.col(c).cast("double") for c in self.inputs]))

    def is_array(self, df: DataFrame) -> bool:
        return len(self.inputs) == 1 and dict(df.dtypes)[self.inputs[0]].startswith("array")

    def is_single(self, df: DataFrame) -> bool:
        """One number per row?"""
        return len(self.inputs) == 1 and not self.is_array(df)


class DetectorModel(ABC):
    """A fitted detector; holds its parameters as written tables or small arrays."""

    name: str
    # Does the model score single rows and keep their other columns? Otherwise it scores windows.
    keeps_rows = True

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``raw_score``, ``threshold``, ``score`` and ``label`` to the rows."""

    def verdict(self, df: DataFrame, name: str) -> DataFrame:
        """Add the outputs as one struct; columns that bear their names stay what they are."""
        own = {c: f"_own_{c}" for c in df.columns if c in OUTPUT}
        out = self.transform(df.withColumns({kept: F.col(c) for c, kept in own.items()}))
        return out.select(*[F.col(own[c]).alias(c) if c in own else F.col(c) for c in df.columns], F.struct(*OUTPUT).alias(name))


def with_label(df: DataFrame, centred: bool) -> DataFrame:
    """Label by ``raw_score > threshold``; the exported score is centred on the threshold or raw."""
    raw, cut = F.col("raw_score"), F.col("threshold")
    return df.withColumn("score", raw - cut if centred else raw).withColumn("label", to_label(raw > cut))


def finish(df: DataFrame, centred: bool) -> DataFrame:
    """Outputs from ``_raw`` and ``_cut``; columns of the rows that bear the outputs' names are replaced."""
    named = df.withColumns({"raw_score": F.col("_raw"), "threshold": F.col("_cut")})
    return with_label(named.drop("_raw", "_cut"), centred)


def check_contamination(contamination: float | str, auto: bool) -> None:
    if contamination == "auto" and auto:
        return
    if isinstance(contamination, str) or not 0 < contamination <= 0.5:
        raise ValueError(f"contamination must be in (0, 0.5]{' or auto' if auto else ''}, got {contamination!r}")
