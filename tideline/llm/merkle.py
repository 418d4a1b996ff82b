"""Document fingerprints: a Merkle tree over sections and paragraphs.

Sections are what empty lines separate, paragraphs are the lines of a section. A paragraph's digest
is that of its text, a section's that of its paragraphs' digests, and the root that of the sections'.
The cuts lose nothing, so equal roots mean equal texts; where roots differ, the sections with
differing digests, and in them the paragraphs, say where. Below the paragraphs hang their clauses,
by which the likeness of two trees is measured: twice the clauses that both have over those of both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.plans.scratch import freeze

CLAUSE = r"[^.,;:!?\n]+[.,;:!?]*|[.,;:!?]+"


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def tree(text: Column) -> Column:
    """``sections``: per section the digests of its paragraphs; ``clauses``: the distinct hashes of clauses."""
    body = F.coalesce(text, F.lit(""))
    paragraphs = lambda section: F.transform(F.split(section, "\n", -1), lambda p: F.sha2(p, 256))
    hashes = F.transform(F.regexp_extract_all(body, F.lit(CLAUSE), F.lit(0)), lambda c: F.xxhash64(c))
    return F.struct(
        F.transform(F.split(body, "\n\n", -1), paragraphs).alias("sections"), F.array_distinct(hashes).alias("clauses")
    )


def root(tree: Column) -> Column:
    """The fingerprint: 64 hexadecimal digits."""
    return _digest(F.transform(tree["sections"], _digest))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1 by the clauses of two trees; 1 for two trees without any."""
    both = F.size(a) + F.size(b)
    return F.when(both > 0, 2.0 * F.size(F.array_intersect(a, b)) / both).otherwise(1.0)


def changed(a: Column, b: Column) -> Column:
    """Where two trees differ: (section, paragraph) from 1 for each paragraph that is not the same.

    Only sections whose digests differ are looked into. Sections and paragraphs are compared place by
    place; one that only one side has differs.
    """

    def places(x: Column, y: Column) -> Column:
        return F.sequence(F.lit(1), F.greatest(F.size(x), F.size(y)))

    def differs(x: Column, y: Column, i: Column) -> Column:
        return ~F.get(x, i - 1).eqNullSafe(F.get(y, i - 1))

    x, y = a["sections"], b["sections"]
    none = F.array().cast("array<string>")

    def inside(s: Column) -> Column:
        p, q = F.coalesce(F.get(x, s - 1), none), F.coalesce(F.get(y, s - 1), none)
        return F.transform(
            F.filter(places(p, q), lambda i: differs(p, q, i)), lambda i: F.struct(s.alias("section"), i.alias("paragraph"))
        )

    return F.flatten(F.transform(F.filter(places(x, y), lambda s: differs(x, y, s)), inside))


def followers(keys: DataFrame, order: Sequence[str]) -> DataFrame:
    """For distinct rows of ``order`` the next one downwards as ``next_…``; after the last the first.

    The rows are range partitioned and each part is numbered by itself; what follows the last row of
    a part is looked up in a table of one row per part.
    """
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = freeze(laid.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "followers")
    row = F.struct(*order)
    tops = laid.groupBy("_part").agg(F.max_by(row, "_at").alias("_top"))
    # At most one row per partition.
    parts_in_order = Window.orderBy("_part")
    last = Window.orderBy(F.desc("_part"))
    edges = tops.select("_part", F.coalesce(F.lag("_top").over(parts_in_order), F.first("_top").over(last)).alias("_edge"))
    below = F.lag(row).over(Window.partitionBy("_part").orderBy("_at"))
    joined = laid.withColumn("_below", below).join(F.broadcast(edges), "_part")
    after = F.coalesce(F.col("_below"), F.col("_edge"))
    return joined.select(*keys.columns, *[after[c].alias(f"next_{c}") for c in order])


def half_replaced(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with their edited text and the trees of the text, the edited text and the next document.

    The order is by key downwards, null keys last; among rows with one key by a hash of the text. Rows
    equal in both count as one document there. The last floor(n / 2) code points of a text of n are
    replaced by the first as many of the next document, or by all of it if it has fewer.
    Columns: key, ``text``, ``tree``, ``edited``, ``edited_tree``, ``next_clauses``.
    """
    rows = df.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    keys = rows.select("_key", "_hash", F.floor(F.length("_text") / 2).cast("int").alias("_half")).distinct()
    pairs = followers(keys, ["_key", "_hash"])
    met = pairs.select(F.col("_key").alias("_for"), F.col("_hash").alias("_for_hash"), "_half", "next__key", "next__hash")
    same = F.col("_key").eqNullSafe(F.col("next__key")) & (F.col("_hash") == F.col("next__hash"))
    pieces = rows.join(met, same).select(
        "_for", "_for_hash", F.substring("_text", F.lit(1), F.col("_half")).alias("_piece"), tree(F.col("_text"))["clauses"].alias("next_clauses")
    )
    repeats = rows.groupBy("_key", "_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeats.isEmpty():
        pieces = pieces.dropDuplicates(["_for", "_for_hash"])
    joined = rows.join(pieces, F.col("_key").eqNullSafe(F.col("_for")) & (F.col("_hash") == F.col("_for_hash")))
    n = F.length("_text")
    edited = F.concat(F.substring("_text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("_piece"))
    out = joined.select(F.col("_key").alias(key), F.col("_text").alias("text"), edited.alias("edited"), "next_clauses")
    # A generator, so that each tree is made once however often it is used.
    trees = F.explode(F.array(F.struct(tree(F.col("text")).alias("tree"), tree(F.col("edited")).alias("edited_tree")))).alias("_t")
    return out.select("*", trees).select(key, "text", "_t.tree", "edited", "_t.edited_tree", "next_clauses")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the root of the tree of ``text``; a null text has that of an empty one."""
    return df.withColumn(out, root(tree(F.col(text))))
