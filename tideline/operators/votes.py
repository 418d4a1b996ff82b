"""Combining the verdicts of several detectors on the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.labels import to_label
from tideline.sources.series import KEY, SERIES, TS

STRATEGIES = ("majority", "unanimous", "any")


def check_strategy(strategy: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"votes are not combined by {strategy!r}; there are {', '.join(STRATEGIES)}")


def decide(votes: Column, voters: Column, strategy: str) -> Column:
    rule = {"majority": 2 * votes > voters, "unanimous": votes == voters, "any": votes > 0}[strategy]
    return to_label(F.when(voters > 0, rule))


def tally(results: DataFrame, keys: Sequence[str] = (SERIES, TS, KEY)) -> DataFrame:
    """Votes for an anomaly and number of verdicts per row; a missing verdict is no vote."""
    return results.groupBy(*keys).agg(F.count_if(F.col("label") == -1).alias("votes"), F.count("label").alias("voters"))


def vote(results: DataFrame, strategy: str = "majority", keys: Sequence[str] = (SERIES, TS, KEY)) -> DataFrame:
    check_strategy(strategy)
    return tally(results, keys).withColumn("label", decide(F.col("votes"), F.col("voters"), strategy))


def vote_all(results: DataFrame, keys: Sequence[str] = (SERIES, TS, KEY)) -> DataFrame:
    """Every strategy's verdict from one tally: ``(keys, strategy, label)``."""
    counted = tally(results, keys)
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("strategy"), decide(F.col("votes"), F.col("voters"), s).alias("label"))
            for s in STRATEGIES
        ]
    )
    return counted.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
