"""Clustering around centroids by equal-average equal-variance search, in whole numbers.

Centroids are sorted by the sum of their components. For a vector the scan starts where its own sum
stands among them and goes outward, the nearer side first. With d components, sums S and lengths V of
what remains when the mean is taken off, a squared distance is at least (S_x - S_c)^2 / d, and at least
that plus (V_x - V_c)^2. The first bound ends a vector's scan, since all that are left are farther off;
the second rejects a single centroid. What remains is computed in whole numbers, so bounds, which are
floating point and leave a margin, decide only what is looked at. Ties go to the smaller number.

The centroids are a parameter's worth of rows and travel to the tasks; of the vectors only sums per
task and cluster move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideline.plans.scratch import freeze

_BATCH = 1 << 13  # vectors searched at a time


def whole(vector: Column, scale: int = 256) -> Column:
    """Components as floor(``scale`` times the component)."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, none of them null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return (F.size(vector) == size) & ~bad


def _largest(size: int) -> int:
    """Components up to this leave squared distances below 2^62."""
    return int((2**62 / max(size, 1)) ** 0.5 / 2)


@dataclass
class Search:
    """Centroids (one line each) with what the bounds need."""

    centroids: np.ndarray

    def __post_init__(self) -> None:
        self.sums = self.centroids.sum(axis=1)
        self.order = np.lexsort((np.arange(len(self.sums)), self.sums))
        self.sorted_sums = self.sums[self.order]
        self.lengths = self._length(self.centroids, self.sums)

    @staticmethod
    def _length(vectors: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return np.sqrt(((vectors - (sums / vectors.shape[1])[:, None]) ** 2).sum(axis=1))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number of and squared distance to the nearest centroid, and how many distances were computed."""
        which, best, computed = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64), 0
        for at in range(0, len(vectors), _BATCH):
            part = slice(at, at + _BATCH)
            which[part], best[part], n = self._nearest(vectors[part])
            computed += n
        return which, best, computed

    def _nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n, size = vectors.shape
        k = len(self.order)
        sums = vectors.sum(axis=1)
        lengths = self._length(vectors, sums)
        up = np.searchsorted(self.sorted_sums, sums)
        down = up - 1
        best = np.full(n, np.iinfo(np.int64).max)
        which = np.full(n, k)
        left, computed = np.arange(n), 0
        while len(left):
            low, high, x = down[left], up[left], sums[left]
            # A side that has no more centroids is infinitely far.
            gap_low = np.where(low >= 0, (x - self.sorted_sums[np.maximum(low, 0)]).astype(float), np.inf)
            gap_high = np.where(high < k, (self.sorted_sums[np.minimum(high, k - 1)] - x).astype(float), np.inf)
            gap = np.minimum(gap_low, gap_high)
            going = gap * gap <= size * best[left].astype(float) * (1 + 1e-9)
            going &= np.isfinite(gap)
            left, low, high, gap = left[going], low[going], high[going], gap[going]
            is_low = gap_low[going] <= gap_high[going]
            candidate = self.order[np.where(is_low, low, high)]
            down[left] -= is_low
            up[left] += ~is_low
            apart = np.maximum(np.abs(lengths[left] - self.lengths[candidate]) - 1e-3, 0) * (1 - 1e-9)
            near = gap * gap / size + apart * apart <= best[left].astype(float) * (1 + 1e-9)
            rows, candidate = left[near], candidate[near]
            apart_by = vectors[rows] - self.centroids[candidate]
            distance = np.einsum("ij,ij->i", apart_by, apart_by)
            computed += len(rows)
            better = (distance < best[rows]) | ((distance == best[rows]) & (candidate < which[rows]))
            best[rows[better]], which[rows[better]] = distance[better], candidate[better]
        return which, best, computed


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    if len(values) and max(-values.min(), values.max()) > _largest(size):
        raise ValueError(f"components beyond {_largest(size)} in magnitude: squared distances would not fit 64 bits")
    return values


def assign(df: DataFrame, centroids: np.ndarray, vector: str = "vector") -> DataFrame:
    """Add ``cluster`` and ``distance`` (squared) of the nearest centroid; ``vector`` holds whole numbers (bigint)."""
    kept = df.drop("cluster", "distance")
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value)
        for batch in batches:
            which, distance, _ = search.nearest(_matrix(batch[vector], search.centroids.shape[1]))
            added = [pa.array(which, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "cluster", "distance"])

    schema = T.StructType([*kept.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return kept.mapInArrow(run, schema)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floor of the mean of their vectors; those without vectors stay."""
    k, size = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts, sums = Search(shared.value), np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            rows = _matrix(batch["vector"], size)
            which, _, _ = search.nearest(rows)
            counts += np.bincount(which, minlength=k)
            np.add.at(sums, which, rows)
        full = np.flatnonzero(counts)
        columns = [pa.array(full, pa.int32()), pa.array(counts[full]), pa.array(list(sums[full]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])

    parts = vectors.select("vector").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    entries = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    total = entries.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    # One row per centroid and component.
    for r in total.collect():
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def cluster(df: DataFrame, k: int, rounds: int, seed: int, key: str = "vec_id", vector: str = "vector") -> tuple[DataFrame, np.ndarray]:
    """Rows with ``cluster`` and ``distance``, and the final centroids.

    ``vector`` holds whole numbers (bigint), equally many in all rows and none null. The centroids start as the
    vectors with the ``k`` smallest SHA-256 (hexadecimal) of ``seed:key``; rows without a key come after all
    others, ties go by the vector. With fewer rows than ``k`` there are as many centroids as rows. Repeated rows
    count as often as they occur. A component too large for exact distances in 64 bits raises an error.
    """
    if k < 1 or rounds < 0:
        raise ValueError("k must be at least 1 and rounds at least 0")
    vectors = freeze(df.select(F.col(vector).alias("vector"), F.struct(*[F.col(c) for c in df.columns]).alias("row")), "vectors")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("row")[key].cast("string")), 256)
    first = vectors.select("vector", named.alias("name")).orderBy(F.asc_nulls_last("name"), "vector").limit(k).collect()
    if not first:
        return df.select("*", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance")).limit(0), np.zeros((0, 0), np.int64)
    centroids = np.array([r["vector"] for r in first], dtype=np.int64)
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)
    placed = assign(vectors, centroids).select(*[F.col("row")[c].alias(c) for c in df.columns if c not in ("cluster", "distance")], "cluster", "distance")
    return placed, centroids


def digest(centroid: np.ndarray) -> str:
    """SHA-256 of the components as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_inertia(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``cluster_inertia`` and ``inertia`` (sums of ``distance``) and ``centroid_sha256``.

    ``placed`` is read twice: write it first.
    """
    spark = placed.sparkSession
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, s, sum(sums.values()), digest(centroids[c])) for c, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row per centroid.
    return placed.drop("cluster_inertia", "inertia", "centroid_sha256").join(F.broadcast(facts), "cluster")
