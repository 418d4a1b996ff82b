"""Materialising intermediate tables where every executor can read them again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

_registered: set[str] = set()
# Each thread, such as that of a micro-batch, has a scope of its own.
_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one in the warehouse.

    All executors must reach it. On a cluster a warehouse on the driver's own disk is therefore refused.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    alone = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
    if not alone and file_system(spark, warehouse)[0].getScheme() == "file":
        raise ValueError(f"set spark.checkpoint.dir to a shared folder: the warehouse {warehouse} is on the driver's disk")
    return f"{warehouse}/_tideline"


def file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for this application's tables, which go when its driver ends."""
    folder = f"{scratch_root(spark)}/tideline/{spark.sparkContext.applicationId}"
    if folder not in _registered:
        files, place = file_system(spark, folder)
        files.mkdirs(place)
        files.deleteOnExit(place)
        _registered.add(folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that this thread writes in the block when it ends; for results used up by then."""
    paths: list[str] = []
    outer = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(outer)
        for path in paths:
            files, place = file_system(spark, path)
            files.delete(place, True)


def freeze(df: DataFrame, label: str = "table", parts: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once and return the written table.

    Cuts the lineage, fixes anything that depends on how rows were partitioned, and gives
    the optimizer the real size of what follows. The rows are counted on the way. ``parts``
    are columns whose values get folders of their own.
    """
    return freeze_at(df, scratch_path(df.sparkSession, label), parts)


def freeze_at(df: DataFrame, path: str, parts: Sequence[str] = ()) -> DataFrame:
    """The same with a path of one's own, which nothing removes."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*parts).parquet(path)
    return frozen_at(df.sparkSession, path, df.schema, seen.get["rows"], parts)


def frozen_at(spark: SparkSession, path: str, schema: StructType, rows: int, parts: Sequence[str] = ()) -> DataFrame:
    """A table that was written before."""
    frozen = spark.read.schema(schema).parquet(path)
    if parts:
        # Columns of folders come last when a table is read.
        frozen = frozen.select(schema.names)
    frozen._tideline_rows, frozen._tideline_parts = rows, tuple(parts)
    return frozen


def parts_of(df: DataFrame) -> tuple[str, ...]:
    """The columns by which a written table is laid out in folders."""
    return getattr(df, "_tideline_parts", ())


def rows_of(df: DataFrame) -> int:
    """Number of rows; known without a job for a table that was just written."""
    known = getattr(df, "_tideline_rows", None)
    return df.count() if known is None else known
