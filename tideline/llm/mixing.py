"""Sources mixed to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the wanted total over what it holds. A document
appears as often as a Poisson variable with that mean says, which is read off the distribution at a
number hashed from a seed and the document. So no state is shared, a third of all rows may come from
one source, and a run again gives the same copies. The copies are put into a global order by another
hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.llm.hashing import SPAN, number, row_key
from tideline.plans.attach import attach
from tideline.plans.scratch import freeze, rows_of

# The most copies that a row may get: they are numbers of one array in a task.
MAX_COPIES = 10_000_000


def source_rates(
    df: DataFrame,
    targets: DataFrame | None = None,
    source: str = "source",
    text: str = "text",
    alpha: float = 0.5,
    total: int | None = None,
) -> DataFrame:
    """One row per source: ``size`` in characters, ``weight`` and ``rate``, the mean number of copies.

    ``targets`` has columns ``source`` and ``weight``; sources it does not name have weight 0, and
    weights below 0 count as 0. Without it a source weighs its size to the power ``alpha``: below 1
    that favours small sources. ``total`` is the wanted number of characters, by default as many as
    there are. A null source is a source of its own. A source without any characters has rate 1.
    """
    sizes = df.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("size")
    )
    if targets is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        wanted = targets.groupBy(F.col("source").alias("_wanted")).agg(F.sum("weight").alias("weight"))
        weighed = sizes.join(wanted, F.col("source").eqNullSafe(F.col("_wanted")), "left").select(
            "source", "size", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight")
        )
    # Sources without characters take no share of the total.
    filled = F.when(F.col("size") > 0, F.col("weight"))
    sums = weighed.agg(
        (F.sum("size") if total is None else F.lit(total)).cast("double").alias("_total"), F.sum(filled).alias("_weights")
    )
    share = F.col("weight") / F.when(F.col("_weights") > 0, F.col("_weights"))
    rate = F.coalesce(share * F.col("_total"), F.lit(0.0)) / F.when(F.col("size") > 0, F.col("size"))
    return weighed.join(F.broadcast(sums)).select("source", "size", "weight", F.coalesce(rate, F.lit(1.0)).alias("rate"))


def _least(rate: Column) -> Column:
    """Fewer copies than these, or more than ``_most``, are too seldom for the hash to hit."""
    return F.greatest(F.floor(rate - 12 * F.sqrt(rate) - 30), F.lit(0)).cast("long")


def _most(rate: Column) -> Column:
    return F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("long")


def _chance(k: Column, rate: Column) -> Column:
    """P(copies = k): by the factorial, beyond 20 by Stirling's series around the mean."""
    exact = k * F.ln(rate) - rate - F.ln(F.factorial(F.least(k, F.lit(20)).cast("int")))
    x = F.greatest(k, F.lit(1)).cast("double")
    off = (x - rate) / rate
    stirling = 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    around = -rate * ((1 + off) * F.log1p(off) - off) - F.ln(2 * math.pi * x) / 2 - stirling
    return F.exp(F.when(k <= 20, exact).otherwise(around))


def _distributions(rates: DataFrame) -> DataFrame:
    """``_source``, ``_first``, ``_cdf``: P(copies <= k) for k = ``_first`` and on.

    A source has 24 standard deviations of rows, which are summed up in order and put into one array.
    """
    rate = F.coalesce(F.when(F.col("rate") > 0, F.col("rate").cast("double")), F.lit(0.0))
    steps = rates.select(F.col("source").alias("_source"), rate.alias("_rate")).select("*", _least(F.col("_rate")).alias("_first"), _most(F.col("_rate")).alias("_last"))
    steps = steps.select("*", F.explode(F.sequence("_first", F.when(F.col("_rate") > 0, F.col("_last")).otherwise(F.lit(0)))).alias("_k"))
    chance = F.when(F.col("_rate") > 0, _chance(F.col("_k"), F.col("_rate"))).otherwise(F.lit(1.0))
    upto = F.sum(chance).over(Window.partitionBy("_source").orderBy("_k"))
    lists = steps.select("_source", "_first", "_k", upto.alias("_p")).groupBy("_source", "_first")
    return lists.agg(F.array_sort(F.collect_list(F.struct("_k", "_p"))).getField("_p").alias("_cdf"))


def replicate(
    df: DataFrame,
    rates: DataFrame,
    seed: int = 0,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """The rows, each as often as its hash says, with ``copy`` from 1 and ``mix_key``.

    Rows with equal keys of one source get equally many copies; a row without a key is hashed by its
    text. Rows of a source that ``rates`` does not name are left out, as if of rate 0. ``copy`` and
    ``mix_key`` replace columns of these names. ``rates`` has one row per source. Where a rate is so high
    that a row could get over ``max_copies`` copies this raises, as it does for rates that are no numbers.
    """
    kept = df.drop("copy", "mix_key")
    rates = freeze(rates.select("source", "rate"), "rates")
    highest = rates.agg(F.max(F.col("rate").cast("double")).alias("rate")).first()["rate"] or 0.0
    if not max(highest, 0.0) + 12 * math.sqrt(max(highest, 0.0)) + 30 <= max_copies:
        raise ValueError(f"a rate of {highest} may give a row over max_copies = {max_copies} copies")
    width = 24 * math.sqrt(max(highest, 0.0)) + 62
    named = kept.withColumn("_source", F.col(source))
    drawn = attach(named, _distributions(rates), ["_source"], row_bytes=int(8 * width) + 64, at_most=rows_of(rates)).drop("_source")
    name = row_key(key, text)
    at = number(F.lit(str(seed)), F.lit("copies"), name) / F.lit(float(SPAN))
    copies = (F.col("_first") + F.size(F.filter("_cdf", lambda p: p <= at))).cast("int")
    return (
        drawn.withColumn("_copies", copies)
        .where(F.col("_copies") > 0)
        .select(*kept.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
        .withColumn("mix_key", number(F.lit(str(seed)), F.lit("order"), name, F.col("copy").cast("string")))
    )


def mix(df: DataFrame, targets: DataFrame | None = None, seed: int = 0, alpha: float = 0.5, total: int | None = None) -> DataFrame:
    """Sources mixed to their weights, in a global order by ``mix_key``."""
    copies = replicate(df, source_rates(df, targets, alpha=alpha, total=total), seed)
    return copies.orderBy("mix_key", "doc_id", "copy")
