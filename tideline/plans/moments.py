"""Sums of outer products per group, reduced on the executors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tideline.plans.attach import attach
from tideline.plans.ordered import overlap, with_position
from tideline.plans.settings import setting

# Matrices held at once by one task before partial sums are passed on.
_HELD_BYTES = 64 * 1024 * 1024


def outer_sums(df: DataFrame, by: Sequence[str], vector: str, average: float | None = None) -> DataFrame:
    """``(by, i, total)``: entry ``i`` of the flattened sum of ``v vᵀ`` over the vectors of a group.

    Put a leading 1 in the vector to obtain the count and the plain sums as well. Each task adds
    up its rows per group; the partial matrices are then summed entry by entry, so no task ever
    sees the rows of a whole group. ``average`` is about how many rows a group has, where that is known.
    """
    keyed = df.select(F.struct(*[F.col(c) for c in by]).alias("_g") if by else F.lit(0).alias("_g"), vector)
    keyed = keyed.withColumn("_g", F.to_json("_g") if by else F.lit("")).where(F.col(vector).isNotNull())

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        size = 0

        def drain() -> pd.DataFrame:
            out = pd.DataFrame({"_g": list(held), "m": list(held.values())})
            held.clear()
            return out

        for batch in batches:
            for g, part in batch.groupby("_g", sort=False):
                x = np.vstack(part[vector].to_numpy())
                # Symmetric: the upper triangle says it all.
                m = (x.T @ x)[np.triu_indices(x.shape[1])]
                if g in held:
                    held[g] += m
                    continue
                held[g] = m
                size += m.nbytes
                if size > _HELD_BYTES:
                    yield drain()
                    size = 0
        if held:
            yield drain()

    return _totals(_gathered(keyed, average).mapInPandas(partial, "_g string, m array<double>"), df, by)


def window_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], vector: str, size: int) -> DataFrame:
    """What ``outer_sums`` gives for (1, w), w the flattened windows of ``size`` consecutive ``vector``s, without windows.

    Windows with a null vector count nothing. Rows lie in blocks that overlap by a window less one row;
    a task passes on one triangle per block, whatever the size of its windows.
    """
    spark = df.sparkSession
    reach = size - 1
    kept = df.select(*by, *order, vector)
    rows = with_position(kept, by, order, "_pos").select(*by, "_pos", vector)
    block = max(setting(spark, "chunkRows"), 4 * reach, 1)
    laid = overlap(rows, "_pos", block, reach, 0).withColumn("_g", F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit(""))

    def partial(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_pos")
        missing = part[vector].isna().to_numpy()
        total = None
        # Stretches between rows without a vector have windows of their own.
        for stretch in np.split(np.arange(len(part)), np.flatnonzero(missing)):
            stretch = stretch[~missing[stretch]]
            if len(stretch) >= size:
                m = lag_sums(np.vstack(part[vector].to_numpy()[stretch]), size)
                total = m if total is None else total + m
        if total is None:
            return pd.DataFrame({"_g": [], "m": []}, dtype=object)
        return pd.DataFrame({"_g": [part["_g"].iloc[0]], "m": [total[np.triu_indices(len(total))]]})

    parts = laid.groupBy("_g", "_block").applyInPandas(partial, "_g string, m array<double>")
    return _totals(parts, df, by)


def lag_sums(x: np.ndarray, size: int) -> np.ndarray:
    """Sum of (1, w)(1, w)ᵀ over all windows of ``size`` rows of ``x``, from products of rows ``lag`` apart.

    The products of the first row of each window with the rows after it are summed over all windows; the
    sums for the next row of the windows differ by a product that leaves at the head and one that enters
    at the tail.
    """
    n, d = x.shape
    count = n - size + 1
    # Products about the middle of the rows, so that a high level does not cancel the differences away.
    middle = x.mean(axis=0)
    c = x - middle
    total = np.empty((size, d, size, d))
    for lag in range(size):
        s = c[:count].T @ c[lag : lag + count]
        for a in range(size - lag):
            if a:
                s = s - np.outer(c[a - 1], c[a - 1 + lag]) + np.outer(c[a - 1 + count], c[a - 1 + lag + count])
            total[a, :, a + lag, :] = s
            total[a + lag, :, a, :] = s.T
    running = np.concatenate([np.zeros((1, d)), np.cumsum(c, axis=0)])
    plain = (running[count : count + size] - running[:size]).ravel()
    level = np.tile(middle, size)
    out = np.empty((1 + size * d, 1 + size * d))
    out[0, 0] = count
    out[0, 1:] = out[1:, 0] = plain + count * level
    cross = np.outer(plain, level)
    out[1:, 1:] = total.reshape(size * d, size * d) + cross + cross.T + count * np.outer(level, level)
    return out


def _totals(parts: DataFrame, df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Entries of both halves from partial triangles ``m`` of the groups ``_g``."""
    sums = (
        parts.select("_g", F.posexplode("m").alias("i", "v"), F.size("m").alias("n"))
        .groupBy("_g", "i", "n")
        .agg(F.sum("v").alias("total"))
    )
    # Back to both halves of the matrix: entry i of the triangle is (row, column) of a p by p matrix.
    p = ((F.sqrt(8.0 * F.col("n") + 1) - 1) / 2).cast("int")
    back = F.col("n") - 1 - F.col("i")
    level = F.floor((F.sqrt(8.0 * back + 1) - 1) / 2).cast("int")
    row = p - 1 - level
    column = p - 1 - (back - (level * (level + 1) / 2).cast("int"))
    places = F.array_distinct(F.array(row * p + column, column * p + row))
    sums = sums.select("_g", F.explode(F.transform(places, lambda i: i.cast("int"))).alias("i"), "total")
    if not by:
        return sums.select("i", "total")
    schema = T.StructType([df.schema[c] for c in by])
    return sums.select(F.from_json("_g", schema).alias("_k"), "i", "total").select("_k.*", "i", "total")


def _gathered(keyed: DataFrame, average: float | None) -> DataFrame:
    """Rows as they are where groups are long; short groups are brought together first.

    A task passes on a matrix for every group that it meets, which is far larger than a row. Spread
    over many tasks, short groups would multiply the data; a group of up to ``shortRows`` rows is
    therefore sent to one task whole, while longer ones stay where they are.
    """
    spark = keyed.sparkSession
    if average is not None and average > setting(spark, "shortRows"):
        return keyed
    sizes = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    if not totals["groups"] or totals["rows"] / totals["groups"] > setting(spark, "shortRows"):
        return keyed
    most = F.lit(setting(spark, "chunkRows"))
    share = F.pmod(F.xxhash64(*keyed.columns[1:]), F.ceil(F.col("n") / most)).cast("int")
    shared = attach(keyed, sizes, ["_g"]).withColumn("_share", share)
    return shared.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_g", "_share").select(*keyed.columns)
