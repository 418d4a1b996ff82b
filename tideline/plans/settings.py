"""Size limits, read from the Spark session so that a cluster can tune them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DEFAULTS = {
    # A window over one group runs in one task up to this many rows; beyond, groups are cut.
    "maxGroupRows": 2_000_000,
    # Rows per range partition and per frame block when groups are cut.
    "chunkRows": 1_000_000,
    # Upper bound on range partitions; also bounds the per-series table of chunk totals.
    "maxChunks": 100_000,
    # A parameter table is broadcast up to this many bytes; beyond, the join is salted.
    "broadcastBytes": 64 * 1024 * 1024,
    # Copies of each parameter row in a salted join, and the most rows to repeat like that.
    "salts": 16,
    "saltedRows": 50_000_000,
    # Rows that one model scores in one task when the models are too many to broadcast.
    "shareRows": 200_000,
    # Groups of up to so many rows on average are gathered before their outer products are summed.
    "shortRows": 1_000,
    # Pivot vectors per group in the neighbour search.
    "pivots": 256,
    # Distinct values per block of the one-dimensional local outlier factor, and rows that ask in one task.
    "valueBlock": 50_000,
    "askedRows": 200_000,
    # Folders that the blocks of fitted values are dealt over; a look-up reads those that it hits.
    "valueParts": 1_024,
    # Rows of one block in blocked neighbour search and in per-block model application.
    "blockRows": 4_096,
}


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(f"spark.tideline.{name}", str(_DEFAULTS[name])))
