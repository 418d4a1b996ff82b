"""Near-duplicates by SimHash, found with covering locality-sensitive hashing.

Every bit position of the 64-bit fingerprint is given a nonzero vector of r + 1 bits, dealt in turn.
Each nonzero vector v of r + 1 bits makes a mask: the positions whose vector has an odd product with
v. Two fingerprints that differ in at most r positions span at most r dimensions there, so some v is
orthogonal to all of them and its mask leaves out every difference: the pair agrees on that mask and
meets in that table. No pair within the radius is missed. For r = 3 there are 15 tables, and each
compares about 34 bits.

Only distinct fingerprints take part, so exact copies cost nothing. Buckets are counted first, with
map-side combination. A bucket of one has no link; up to ``bucket_rows`` fingerprints are compared in
one task, which passes on a spanning forest, not the pairs. A larger bucket is not compared there but
covered again on the positions it has not yet agreed on, which halves these each time; at most 2^k
distinct fingerprints share all but k positions, so it ends after a few levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.components import components
from tideline.plans.attach import attach
from tideline.plans.scratch import freeze, rows_of

BITS = 64
_BLOCK = 1 << 15  # shingles counted at a time


def simhash(text: str | None, words: int = 3) -> int:
    """Fingerprint of a text as a signed 64-bit number.

    A-Z is lower-cased, words are separated by ASCII white space, shingles of ``words`` words are
    hashed by XXH64 with seed 42, repeats included; a bit is set if it is in over half of the
    hashes. Fewer words make one shingle; without words the fingerprint is 0.
    """
    parts = text.encode().lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    take = min(words, len(parts))
    begins, stops = (ends - sizes)[: len(parts) - take + 1], ends[take - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(begins), _BLOCK):
        a, b = begins[at : at + _BLOCK].tolist(), stops[at : at + _BLOCK].tolist()
        hashes = np.array([digest(joined[i:j], 42) for i, j in zip(a, b)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(begins), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "simhash", words: int = 3) -> DataFrame:
    """Add the fingerprint of ``text`` as a bigint; null, empty and all-white texts get 0."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words) for t in texts], dtype="int64")

    return df.withColumn(out, run(F.col(text)))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def cover(agreed: int, radius: int) -> list[int]:
    """Masks, as unsigned numbers, that contain ``agreed`` and cover the other positions."""
    vectors = 2 ** (radius + 1) - 1
    free = [i for i in range(BITS) if not agreed >> i & 1]
    masks = []
    for v in range(1, vectors + 1):
        mask = agreed
        for j, position in enumerate(free):
            if (j % vectors + 1 & v).bit_count() % 2:
                mask |= 1 << position
        masks.append(mask)
    return masks


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _forest(values: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect what the pairs within the radius connect, one fewer than members per component."""
    left = values
    while len(left) > 1:
        border, left = [left[0]], left[1:]
        while border and len(left):
            node = border.pop()
            near = np.bitwise_count(left ^ node) <= radius
            for other in left[near]:
                yield int(other), int(node)
            border.extend(left[near])
            left = left[~near]


def _link_runs(radius: int):
    """Links within runs of equal (agreed, key) in sorted rows; a run may reach over batches."""

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for last, frame in _with_last(frames):
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            agreed, key = rows["agreed"].to_numpy(), rows["key"].to_numpy()
            fresh = np.flatnonzero((agreed[1:] != agreed[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], fresh, [len(rows)]])
            if not last:
                rest = rows.iloc[starts[-2] :]
                starts = starts[:-1]
            values = rows["simhash"].to_numpy().astype("int64").view("uint64")
            found = [x for a, b in zip(starts[:-1], starts[1:]) if b - a > 1 for x in _forest(values[a:b], radius)]
            yield pd.DataFrame(np.array(found, dtype="uint64").reshape(-1, 2).view("int64"), columns=["a", "b"])

    return link


def _with_last(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    held = None
    for frame in frames:
        if held is not None:
            yield False, held
        held = frame
    if held is not None:
        yield True, held


def near_links(distinct: DataFrame, radius: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """Links (``a``, ``b``) between fingerprints of ``simhash`` (distinct, not null) that connect
    exactly the fingerprints connected by pairs that differ in at most ``radius`` positions."""
    if radius < 0 or bucket_rows < 2:
        raise ValueError("radius must be at least 0 and bucket_rows at least 2")
    spark = distinct.sparkSession
    rows = distinct.select(F.lit(0).cast("long").alias("agreed"), "simhash")
    wide = [0]
    found: list[DataFrame] = []
    while True:
        # Which masks follow which: bounded by the radius and the level, not by the data.
        masks = {_signed(a): [_signed(m) for m in cover(a, radius) if m != a] for a in wide}
        if wide == [0]:
            masked = rows.select("simhash", F.explode(F.array(*map(F.lit, masks[0]))).alias("mask"))
        else:
            # At most 15 to the power of the level rows for a radius of 3.
            pairs = [(a, m) for a, ms in masks.items() for m in ms]
            masked = rows.join(F.broadcast(spark.createDataFrame(pairs, "agreed bigint, mask bigint")), "agreed")
        spread = masked.select(
            F.col("mask").alias("agreed"), F.col("simhash").bitwiseAND(F.col("mask")).alias("key"), "simhash"
        )
        shared = spread.groupBy("agreed", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = attach(spread, shared, ["agreed", "key"], row_bytes=64)
        compared = members.where(F.col("n") <= bucket_rows).select("agreed", "key", "simhash")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        links = compared.repartition(parts, "agreed", "key").sortWithinPartitions("agreed", "key")
        found.append(freeze(links.mapInPandas(_link_runs(radius), "a bigint, b bigint"), "near"))
        rows = freeze(members.where(F.col("n") > bucket_rows).select("agreed", "simhash"), "wide")
        if not rows_of(rows):
            break
        wide = [r["agreed"] % (1 << BITS) for r in rows.select("agreed").distinct().collect()]
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def near_components(prints: DataFrame, radius: int = 3, key: str = "doc_id", bucket_rows: int = 4096) -> DataFrame:
    """Add ``component_id``: the least ``key`` among the rows that a row reaches over links.

    ``prints`` needs the column ``simhash`` and is read several times: write it first. Rows without
    a key link as others do but name no component; one of such rows alone has a null id.
    """
    kept = prints.drop("component_id")
    distinct = freeze(kept.groupBy("simhash").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    roots = components(near_links(distinct.select("simhash"), radius, bucket_rows))
    rooted = distinct.join(roots.withColumnRenamed("node", "simhash"), "simhash", "left")
    grouped = freeze(rooted.where("root is not null or n > 1").withColumn("root", F.coalesce("root", "simhash")), "rooted")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = attach(grouped, least, ["root"], row_bytes=32).select("simhash", "component_id", F.lit(True).alias("_grouped"))
    joined = attach(kept, named, ["simhash"], "left", row_bytes=32)
    return joined.withColumn("component_id", F.when(F.col("_grouped"), F.col("component_id")).otherwise(F.col(key))).drop("_grouped")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row of every component: the least key, rows without a key last, ties by a hash of the row.

    Of rows that are equal in all columns one is kept. Rows are told apart by key and row hash. Columns may
    bear any name.
    """
    hashed = F.xxhash64(*[F.col(c) for c, t in df.dtypes if "map<" not in t])
    named = df.select(F.col(key).alias("key"), hashed.alias("hash"), F.col(text).alias("text"))
    prints = freeze(fingerprints(named, words=words).select("key", "hash", "simhash"), "rows")
    # A row hash stands for a row where the component has to be named even without a key.
    distinct = freeze(prints.select("simhash").distinct(), "prints")
    roots = components(near_links(distinct, radius))
    table = freeze(roots.withColumnRenamed("node", "simhash"), "roots")
    rows = prints.groupBy("key", "hash", "simhash").agg(F.count(F.lit(1)).alias("n"))
    rooted = attach(rows, table, ["simhash"], "left", row_bytes=32, frozen=True).withColumn("root", F.coalesce("root", "simhash"))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "hash", "n")
    chosen = freeze(rooted.groupBy("root").agg(F.min(order).alias("x")).select("x.key", "x.hash", "x.n"), "chosen")
    packed = df.select(F.col(key).alias("_key"), hashed.alias("_hash"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    first = packed.join(chosen, F.col("_key").eqNullSafe(F.col("key")) & (F.col("_hash") == F.col("hash")))
    single = first.where("n = 1").select("row.*")
    return single.union(first.where("n > 1").dropDuplicates(["key", "hash"]).select("row.*"))
