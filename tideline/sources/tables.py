"""Series and results kept in database tables.

Expected tables: ``time_series(id, name, ts, value, …)`` and
``detection_results(id, series_name, method, results, …)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.plans import with_position
from tideline.sources.series import KEY, SERIES, TS, require_rows, standardise

# Table names.
SERIES_TABLE = "time_series"
RESULTS_TABLE = "detection_results"


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str = SERIES_TABLE,
    id_bounds: tuple[int, int] | None = None,
    partitions: int = 32,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table; with ``id_bounds`` it is read in parallel by ranges of ``id``."""
    reader = spark.read.format("jdbc").options(**jdbc_options(url, table, id_bounds, partitions, properties))
    return reader.load()


def jdbc_options(
    url: str,
    table: str,
    id_bounds: tuple[int, int] | None = None,
    partitions: int = 32,
    properties: dict[str, str] | None = None,
) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "fetchsize": "10000", "batchsize": "10000", **(properties or {})}
    if id_bounds:
        low, high = id_bounds
        options.update(
            partitionColumn="id", lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)
        )
    return options


def fetch_series(table: DataFrame, names: str | Sequence[str]) -> DataFrame:
    """The named series of a ``time_series`` table; the filter reaches the source."""
    names = [names] if isinstance(names, str) else list(names)
    rows = table.where(F.col("name").isin(names))
    key = "id" if "id" in table.columns else None
    picked = rows.select("name", "ts", "value", *([key] if key else []))
    return require_rows(
        standardise(picked, "ts", "value", series="name", key=key), f"no data found for series {names}"
    )


def series_rows(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows to append to a ``time_series`` table."""
    if value not in df.columns:
        raise ValueError(f"a {value!r} column is needed")
    return df.select(F.col(SERIES).alias("name"), F.col(TS).alias("ts"), F.col(value).cast("double").alias("value"))


def result_rows(
    results: DataFrame, detector: str = "detector", points: bool = True, points_per_document: int = 10_000
) -> DataFrame:
    """JSON documents for a ``detection_results`` table: every point, or a summary without ``points``.

    Documents hold up to ``points_per_document`` points, so that none grows with the length of its
    series; ``part`` numbers those of a series and method from 0 in time order.
    """
    if not points:
        body = results.groupBy(SERIES, detector).agg(
            F.count(F.lit(1)).alias("points"),
            F.count_if(F.col("label") == -1).alias("anomalies"),
            F.min(TS).alias("first_ts"),
            F.max(TS).alias("last_ts"),
            F.max("score").alias("max_score"),
        )
        document = F.struct("points", "anomalies", "first_ts", "last_ts", "max_score")
        return body.select(
            F.col(SERIES).alias("series_name"), F.col(detector).alias("method"), F.to_json(document).alias("results")
        )
    placed = with_position(results, [SERIES, detector], [TS, KEY], "_place")
    part = F.floor(F.col("_place") / F.lit(points_per_document)).cast("int")
    body = placed.groupBy(SERIES, detector, part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct(TS, KEY, "score", "label"))).alias("points")
    )
    return body.select(
        F.col(SERIES).alias("series_name"), F.col(detector).alias("method"), "part", F.to_json(F.struct("points")).alias("results")
    )


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Append rows over JDBC.

    Each partition commits on its own, so a retried task can write rows twice: point this at a
    staging table and merge from there where that matters.
    """
    df.write.format("jdbc").options(**jdbc_options(url, table, properties=properties)).mode("append").save()
