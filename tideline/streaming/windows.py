"""Tumbling aggregates of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tideline.functions.labels import outside
from tideline.plans import attach, freeze, rows_of, scratch_path
from tideline.sources.series import SERIES, TS
from tideline.streaming.scoring import BATCH


def tumbling(
    df: DataFrame, every: str = "1 hour", late: str | None = None, value: str = "value", by: Sequence[str] = (SERIES,), ts: str = TS
) -> DataFrame:
    """Count, sum, least and greatest value per series and window of ``every``.

    On a stream, ``late`` is how long a window waits for rows that arrive out of order: the state of
    a window is dropped once the watermark has passed it. A batch needs none.
    """
    # Event time in a watermark has to be a timestamp with time zone.
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if late is not None:
        timed = timed.withWatermark(ts, late)
    window = F.window(ts, every)
    return timed.groupBy(*by, window.alias("window")).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest")
    ).select(
        *by, F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), "n", "total", "least", "greatest"
    )


def refreshed(aggregates: DataFrame) -> DataFrame:
    """The aggregates of all that is available now; every micro-batch writes the table anew.

    All windows stay open, so the state grows with the stream and ``late`` has no effect; ``closed`` has both.
    """
    spark = aggregates.sparkSession
    folder = scratch_path(spark, "aggregates")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    query = aggregates.writeStream.outputMode("complete").foreachBatch(write)
    query.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(aggregates.schema).parquet(f"{folder}/rows")


def band(aggregates: DataFrame, value: str = "total", width: float = 2.0, by: Sequence[str] = (SERIES,)) -> DataFrame:
    """``lower`` and ``upper`` per series: mean and ``width`` sample deviations of past windows, written once."""
    centre, reach = F.avg(value), F.lit(width) * F.stddev_samp(value)
    return freeze(aggregates.groupBy(*by).agg((centre - reach).alias("lower"), (centre + reach).alias("upper")), "band")


def outside_band(aggregates: DataFrame, bounds: DataFrame, value: str = "total", by: Sequence[str] = (SERIES,)) -> DataFrame:
    """Add the bounds of each series and ``is_anomaly``; a series without bounds is never outside.

    ``bounds`` is a written table with one row per series. It stands still while ``aggregates``, which may
    be a stream, go by.
    """
    kept = aggregates.drop("lower", "upper", "is_anomaly")
    joined = attach(kept, bounds.select(*by, "lower", "upper"), by, "left", row_bytes=64, at_most=rows_of(bounds))
    return joined.withColumn("is_anomaly", outside(value, "lower", "upper"))


def start_closed(aggregates: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write every window once, when the watermark has passed its end, and forget it.

    ``aggregates`` come from ``tumbling`` with ``late``, without which no window ever ends. Rows for a window
    that has ended are refused. A batch has a folder of its own below ``path`` that a repeated batch overwrites.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    query = aggregates.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def closed(aggregates: DataFrame) -> DataFrame:
    """The windows that end within all that is available now."""
    spark = aggregates.sparkSession
    folder = scratch_path(spark, "closed")
    start_closed(aggregates, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return read_batches(spark, f"{folder}/rows", aggregates.schema)


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What a stream has written below ``path`` so far."""
    return spark.read.schema(schema).parquet(path).select(schema.names)
