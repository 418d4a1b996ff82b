"""Merkle manifest of a dataset: trees over the rows of each group, and one over the groups.

A tree is built level by level. At every level each node meets the other nodes of its run by equijoins
on the siblings' computed places (its own place, moved on by 1 … ``arity`` - 1 slots within the run; for
``arity`` 2 that is the place with its last bit turned), so that every row then has its siblings to the
left and right. The rows of slot zero emit the parents. A tree with one node is finished, and that node
is its top; a last run may be shorter, even one node. On the way back down every node passes its
siblings and those above it on to its children, until each leaf has its path to the root.

Digests are kept as 32 bytes and hashed as their lowercase hexadecimal text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.plans.attach import attach
from tideline.plans.scratch import freeze, rows_of

_PATH = "array<struct<left:binary,right:binary>>"


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row: each value's UTF-8 length, a colon and the value, or a minus sign for null."""
    texts = [c.cast("string") for c in columns]
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def fold(digest: Column, path: Column) -> Column:
    """The root (hexadecimal) that follows from a leaf's digest and the siblings on its path."""
    return F.aggregate(path, as_hex(digest), lambda x, s: F.sha2(F.concat(as_hex(s["left"]), x, as_hex(s["right"])), 256))


def proof(path: Column) -> Column:
    """One digest (hexadecimal) of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(as_hex(s["left"]), as_hex(s["right"]))), ""), 256)


def _placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number the nodes of each tree from 0 in ``order``, without bringing a tree together.

    Sorted ranges of all nodes cut the trees; a place is the node's place in its range and tree plus the
    nodes of the tree in earlier ranges. Of those counts there are at most as many as ranges and trees.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    at = F.monotonically_increasing_id()
    laid = freeze(laid.withColumn("_at", at).withColumn("_range", F.shiftright("_at", 33)), "laid")
    counts = laid.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("tree", "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = attach(laid, starts, ["tree", "_range"], row_bytes=96)
    return joined.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Add ``left`` and ``right``: the digests of the siblings before and after, one after the other."""
    slot = F.pmod(F.col("place"), F.lit(arity))
    others = nodes.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), F.col("digest").alias("_digest"))
    joined = nodes
    for shift in range(1, arity):
        moved = F.pmod(slot + shift, F.lit(arity))
        sibling = others.withColumnsRenamed({c: f"{c}_{shift}" for c in others.columns})
        meets = (F.col("tree") == F.col(f"_tree_{shift}")) & (F.col("place") - slot + moved == F.col(f"_place_{shift}"))
        joined = joined.join(sibling, meets, "left")
    # The sibling in slot j is the one that was reached by j - slot steps.
    by_slot = [
        F.coalesce(*[F.when(F.pmod(slot + s, F.lit(arity)) == j, F.col(f"_digest_{s}")) for s in range(1, arity)], F.lit(b""))
        for j in range(arity)
    ]
    left = F.concat(*[F.when(slot > j, d).otherwise(F.lit(b"")) for j, d in enumerate(by_slot)])
    right = F.concat(*[F.when(slot < j, d).otherwise(F.lit(b"")) for j, d in enumerate(by_slot)])
    return joined.select(*nodes.columns, left.alias("left"), right.alias("right"))


def _is_top() -> Column:
    return (F.col("place") == 0) & (F.length("right") == 0)


def _climb(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The levels of all trees from the leaves up; a tree's top is in the last level that it has."""
    levels = []
    while True:
        level = freeze(_with_siblings(nodes, arity), "level")
        levels.append(level)
        parents = level.where((F.pmod("place", F.lit(arity)) == 0) & ~_is_top()).select(
            "tree",
            F.floor(F.col("place") / F.lit(arity)).cast("long").alias("place"),
            F.unhex(F.sha2(F.concat(as_hex(F.col("digest")), as_hex(F.col("right"))), 256)).alias("digest"),
        )
        nodes = freeze(parents, "parents")
        if not rows_of(nodes):
            return levels


def _tops(levels: Sequence[DataFrame]) -> DataFrame:
    """``tree`` and the ``digest`` of its top."""
    found = [level.where(_is_top()).select("tree", "digest") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _descend(levels: Sequence[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """The lowest level with ``path`` and what else ``above`` has for the tops of the trees."""
    kept = [c for c in above.columns if c not in ("tree", "path")]
    parents = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        tops = level.where(_is_top()).join(above, "tree").select(*level.columns, "path", *kept)
        below = tops
        if parents is not None:
            up = parents.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), "path", *kept)
            meets = (F.col("tree") == F.col("_tree")) & (F.floor(F.col("place") / F.lit(arity)).cast("long") == F.col("_place"))
            path = F.concat(F.array(F.struct("left", "right")), F.col("path"))
            below = level.where(~_is_top()).join(up, meets).select(*level.columns, path.alias("path"), *kept).union(tops)
        if k == 0:
            return below
        parents = freeze(below.select("tree", "place", "path", *kept), "paths")
    raise AssertionError("a tree has one level at least")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the given rows with ``path`` (the siblings from the leaf to the root) and ``subroot``
    (hexadecimal); ``subroots``: per group its ``digest`` and place; ``root``: hexadecimal, None if empty."""

    leaves: DataFrame
    subroots: DataFrame
    root: str | None


def build(rows: DataFrame, group: str = "group", order: Sequence[str] = ("key",), digest: str = "digest", arity: int = 3) -> Manifest:
    """Manifest of ``rows``, whose ``digest`` is binary.

    Leaves stand by ``order`` (nulls first) within their group, rows that tie in it by digest; groups stand by
    name, UTF-8 bytewise, null first. Rows may repeat. Other columns may bear any name; ``path`` and ``subroot``
    are replaced.
    """
    if arity < 2:
        raise ValueError("arity must be at least 2")
    nodes = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.struct(*order).alias("key"),
        F.col(digest).alias("digest"),
        F.struct(*[F.col(c) for c in rows.columns]).alias("row"),
        # Equal rows are told apart, so that a range can end between them.
        F.monotonically_increasing_id().alias("tie"),
    )
    nodes = freeze(nodes, "leaves")
    levels = _climb(_placed(nodes, ["key", "digest", "tie"]).select("tree", "place", "digest", "row"), arity)
    subroots = freeze(_tops(levels), "subroots")
    forest = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper = _climb(_placed(forest, ["name"]), arity)
    first = _tops(upper).first()
    start = upper[-1].where(_is_top()).select("tree", F.array().cast(_PATH).alias("path"))
    above = freeze(_descend(upper, start, arity).select(F.col("name").alias("tree"), "path", as_hex(F.col("digest")).alias("subroot")), "above")
    kept = [F.col("row")[c].alias(c) for c in rows.columns if c not in ("path", "subroot")]
    leaves = _descend(levels, above, arity).select(*kept, "path", "subroot")
    places = upper[0].select(F.when(F.col("name") != "", F.substr("name", F.lit(2))).alias(group), "place", as_hex(F.col("digest")).alias("digest"))
    return Manifest(leaves, places, None if first is None else bytes(first["digest"]).hex())
