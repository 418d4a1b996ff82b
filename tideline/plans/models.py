"""Applying per-group models, kept as table rows, to the vectors of the groups."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tideline.plans.attach import attach
from tideline.plans.scratch import freeze, rows_of
from tideline.plans.settings import setting

# From vectors and the model's columns to one value (a number or a list of numbers) per vector.
Kernel = Callable[[np.ndarray, dict[str, Any]], Sequence[Any]]


def group_key(by: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit("")


def fields(df: DataFrame, columns: Sequence[str]) -> str:
    """The columns of ``df`` as part of a schema string."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.empty((0, 0))


def apply_models(
    df: DataFrame,
    by: Sequence[str],
    vector: str,
    models: DataFrame,
    kernel: Kernel,
    name: str,
    model_bytes: int,
    returns: str = "double",
) -> DataFrame:
    """Add ``name`` = kernel(vectors, model of the group); null without a vector or a model (or for NaN).

    ``models`` is a written table with any number of rows per group. While all of them fit into
    the broadcast limit they travel to the executors once and the rows stay where they are.
    Otherwise rows meet their model by group and share, a share being a bounded part of a group.
    """
    by = list(by)
    spark = df.sparkSession
    keyed_models = models.withColumn("_g", group_key(by)).drop(*by)
    params = [c for c in keyed_models.columns if c != "_g"]

    def as_model(rows: pd.DataFrame) -> dict[str, Any]:
        return {c: rows[c].to_list() for c in params}

    def empty(n: int) -> np.ndarray:
        return np.full(n, np.nan) if returns == "double" else np.full(n, None, dtype=object)

    def fill(out: np.ndarray, places: np.ndarray, values: Sequence[Any]) -> None:
        if returns == "double":
            out[places] = values
        else:
            out[places] = np.fromiter(values, dtype=object, count=len(places))

    if rows_of(models) * model_bytes <= setting(spark, "broadcastBytes"):
        table = keyed_models.toPandas()
        shared = spark.sparkContext.broadcast({g: as_model(rows) for g, rows in table.groupby("_g")})

        @F.pandas_udf(returns)
        def score(keys: pd.Series, vectors: pd.Series) -> pd.Series:
            out = empty(len(keys))
            usable = vectors.notna().to_numpy()
            for g, places in keys.groupby(keys).indices.items():
                places = places[usable[places]]
                if g in shared.value and len(places):
                    fill(out, places, kernel(matrix(vectors.iloc[places]), shared.value[g]))
            return pd.Series(out)

        return df.withColumn(name, score(group_key(by), F.col(vector)))

    sizes = freeze(df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(setting(spark, "shareRows"))).cast("int").alias("_shares")), "sizes")
    scalars = [c for c, t in df.dtypes if not t.startswith("map")]
    shared_rows = (
        attach(df, sizes, by, frozen=True)
        .withColumn("_share", F.pmod(F.xxhash64(*scalars), F.col("_shares")).cast("int"))
        .withColumn("_g", group_key(by))
        .drop("_shares")
    )
    copies = (
        attach(models, sizes, by, frozen=True)
        .withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
        .withColumn("_g", group_key(by))
        .select("_g", "_share", *params)
    )
    schema = f"{fields(df, df.columns)}, `{name}` {returns}"

    def meet(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns=["_g", "_share"])
        out = empty(len(rows))
        usable = np.flatnonzero(rows[vector].notna().to_numpy())
        if len(model) and len(usable):
            fill(out, usable, kernel(matrix(rows[vector].iloc[usable]), as_model(model)))
        return rows.assign(**{name: out})

    return shared_rows.groupBy("_g", "_share").cogroup(copies.groupBy("_g", "_share")).applyInPandas(meet, schema)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by ``keys`` into as many parts as shuffles use.

    Rows that need much work each are few bytes in all; left to itself the optimizer would put
    them into one partition.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def uniform(seed: int, stream: str, *columns: Column | str) -> Column:
    """A number in (0, 1) that depends on the seed, the stream and the columns only."""
    bits = F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), *columns), F.lit(2**52))
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def sample_rate(wanted: int, rows: Column) -> Column:
    """Rate at which at least ``wanted`` of ``rows`` rows are drawn, up to a five-sigma miss."""
    return F.least(F.lit(1.0), F.lit(wanted + 5 * math.sqrt(wanted)) / rows)
