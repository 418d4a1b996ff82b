"""Exact nearest vectors by partitions, in two phases.

A few vectors of a group serve as pivots, and every vector belongs to the cell of its nearest pivot. An
asked vector is first compared with its own cell. The distance of the k-th vector found there bounds how
far it has to look; by the triangle inequality a cell can matter only if its pivot, less the cell's radius,
is within that bound, and so is half of what its pivot is farther off than the own one. Cells in their order
make up bundles, each a fixed share of the table while that fits a task; the vector goes once to every bundle
that holds such a cell, and is compared there, cell by cell, with those that its bound still allows. So a vector
is copied a fixed number of times however many cells it has to look into, and beyond that as often as memory
demands. Only the k best of a bundle travel on, never pairs, and they are merged a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.plans import attach, freeze, rows_of
from tideline.plans.attach import join_null_safe
from tideline.plans.models import apply_models, fields, group_key, matrix, sample_rate, spread, uniform
from tideline.plans.settings import setting

_SLACK = 1e-9
_MERGE = 64

# A task holds this share of either side, or as many bytes of vectors if the share is more than that.
_SHARES = 8
_HELD_BYTES = 32 * 1024 * 1024

# Rows compared at once within a task.
_PIECE = 4_096


def _by_dimension(start: float, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.full((len(a), len(b)), start)
        for j in range(a.shape[1]):
            total = step(total, np.abs(a[:, j, None] - b[None, :, j]))
        return total

    return distances


METRICS = {
    "euclidean": lambda a, b: np.sqrt(_by_dimension(0.0, lambda t, d: t + d * d)(a, b)),
    "manhattan": _by_dimension(0.0, lambda t, d: t + d),
    "chebyshev": _by_dimension(0.0, np.maximum),
}


def _paired(start: float, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.full(len(a), start)
        for j in range(a.shape[1]):
            total = step(total, np.abs(a[:, j] - b[:, j]))
        return total

    return distances


# The same of rows side by side, added up in the same order.
PAIRED = {
    "euclidean": lambda a, b: np.sqrt(_paired(0.0, lambda t, d: t + d * d)(a, b)),
    "manhattan": _paired(0.0, lambda t, d: t + d),
    "chebyshev": _paired(0.0, np.maximum),
}


def nearest(
    asked: DataFrame, known: DataFrame, by: Sequence[str], k: int, metric: str, block: int | None = None, counts: dict[str, int] | None = None
) -> DataFrame:
    """The ``k`` nearest known vectors of every asked one: ``(by, _qid, _near)``.

    ``asked`` has ``(by, _vid, _x)`` and ``known`` ``(by, _vid, _m, _x)``, both written tables.
    ``_near`` lists ``(d, vid, m)`` from near to far, equal distances by ``vid``. A cell has about ``block`` rows or,
    with as many pivots as there may be, more. ``counts`` is told how many pairs of blocks, of ``block`` rows or of what a
    task holds, were compared at home and elsewhere.
    """
    same = asked is known
    by = list(by)
    block = block or setting(asked.sparkSession, "blockRows")
    counts = {} if counts is None else counts
    # Fresh columns, since both sides may be the same table.
    asked = asked.select(*by, F.col("_vid").alias("_qid"), F.col("_x").alias("_x"))
    if rows_of(known) <= block:
        # Few known vectors: one cell per group.
        asked_cells, known_cells = (d.withColumn("_cell", F.lit(0)) for d in (asked, known))
        found, counts["home"] = _compared(asked_cells, known_cells, by, k, metric, block)
        return found
    p = known.select(F.max(F.size("_x")).alias("p")).first()["p"]
    pivot_bytes = 16 * p + 64
    held, asking_held = (_held(rows_of(d), p, block) for d in (known, asked))
    pivots = freeze(_pivots(known, by, block), "pivots")
    known_cells = _placed(known, by, pivots, metric, pivot_bytes)
    if same:
        asked_cells = known_cells.select(*by, F.col("_vid").alias("_qid"), *[F.col(c).alias(c) for c in ("_x", "_cell", "_d")])
    else:
        asked_cells = _placed(asked, by, pivots, metric, pivot_bytes)
    home, counts["home"] = _compared(asked_cells.drop("_d"), known_cells.drop("_d"), by, k, metric, held)
    home = freeze(home, "home")
    # Without k vectors at home there is no bound, and without any there is no row of ``home`` either.
    kth = home.select(*by, "_qid", F.try_element_at("_near", F.lit(k))["d"].alias("_kth"))
    asking = join_null_safe(asked_cells, kth, [*by, "_qid"], how="left").withColumn("_kth", F.coalesce("_kth", F.lit(float("inf"))))
    cells = known_cells.groupBy(*by, "_cell").agg(F.max("_d").alias("_radius"), F.count(F.lit(1)).alias("_n"))
    # At most as many rows of a group as it has pivots.
    before = F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    reach = attach(pivots, cells.withColumn("_first", F.coalesce(before, F.lit(0))), [*by, "_cell"])
    bundle = [F.floor(F.col("_first") / held).alias("_low"), F.floor((F.col("_first") + F.col("_n") - 1) / held).alias("_high")]
    reach = freeze(reach.select("*", *bundle), "reach")
    asking = asking.withColumn("_b", F.concat("_x", F.array("_kth", "_d", "_cell")))
    away = apply_models(asking, by, "_b", reach, _within(metric), "_bundles", pivot_bytes + 40, returns="array<double>")
    away = away.where(F.size("_bundles") > 0).select(*by, "_qid", "_x", "_kth", F.col("_cell").alias("_home"), F.col("_bundles").cast("array<int>").alias("_bundles"))
    place = F.col("_first") + F.pmod(F.xxhash64("_vid"), F.col("_n"))
    bundled = attach(known_cells.drop("_d"), reach.drop("_p", "_radius", "_low", "_high"), [*by, "_cell"], at_most=rows_of(reach))
    bundled = bundled.withColumn("_bundle", F.floor(place / held).cast("int")).drop("_first", "_n")
    others, counts["away"] = _searched(freeze(away, "away"), bundled, by, k, metric, asking_held)
    return home.union(others).groupBy(*by, "_qid").agg(_merged(k))


def _held(rows: int, p: int, block: int) -> int:
    """How many vectors of a table a task holds."""
    return max(block, min(-(-rows // _SHARES), _HELD_BYTES // (8 * max(p, 1))))


def _searched(asked: DataFrame, known: DataFrame, by: list[str], k: int, metric: str, held: int) -> tuple[DataFrame, int]:
    """Up to ``k`` vectors of the bundles that an asked one goes to, cells other than its own, that its bound lets in.

    Also how many pairs of a bundle and a block of asked vectors were compared.
    """
    sizes = asked.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(held)).cast("int").alias("_qn"))
    left = attach(asked, sizes, by).withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.col("_qn")).cast("int")).drop("_qn")
    left = left.withColumn("_bundle", F.explode("_bundles")).drop("_bundles")
    # A row per bundle: the blocks of asked vectors that look into it.
    pairs = freeze(left.groupBy(*by, "_bundle").agg(F.collect_set("_qb").alias("_qbs")), "bundles")
    met, most = pairs.agg(F.sum(F.size("_qbs")), F.max("_bundle")).first()
    right = attach(known, pairs, [*by, "_bundle"], frozen=True).withColumn("_qb", F.explode("_qbs")).drop("_qbs")
    left, right = (d.withColumn("_g", group_key(by)) for d in (left, right))
    keys = ["_g", "_bundle", "_qb"]
    schema = f"{fields(left, [*by, '_qid', '_bundle'])}, d array<double>, vid array<bigint>, m array<bigint>"

    def compare(these: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        if not len(these) or not len(those):
            nothing = pd.Series(dtype=object)
            return these[[*by, "_qid", "_bundle"]].head(0).assign(d=nothing, vid=nothing, m=nothing)
        # Vectors of one cell are compared together, since they are near and far from the same cells.
        these, those = these.sort_values("_home"), those.sort_values("_cell")
        vid, m, cell = those["_vid"].to_numpy(), those["_m"].to_numpy(), those["_cell"].to_numpy()
        home, bound = these["_home"].to_numpy(), these["_kth"].to_numpy()
        places, d = _best_within(matrix(these["_x"]), home, bound, matrix(those["_x"]), cell, vid, k, metric)
        found = [row >= 0 for row in places]
        out = these[[*by, "_qid", "_bundle"]].assign(
            d=[row[f] for row, f in zip(d, found)], vid=[vid[row[f]] for row, f in zip(places, found)], m=[m[row[f]] for row, f in zip(places, found)]
        )
        return out[places[:, 0] >= 0]

    left, right = spread(left, *keys), spread(right.drop(*by), *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)
    out = found.select(*by, "_qid", F.col("_bundle").alias("_round"), F.arrays_zip("d", "vid", "m").alias("_near"))
    return _merged_in_rounds(out, by, k, (most or 0) + 1), met or 0


def _merged(k: int, repeats: bool = False) -> Column:
    near = F.flatten(F.collect_list("_near"))
    return F.slice(F.sort_array(F.array_distinct(near) if repeats else near), 1, k).alias("_near")


def _merged_in_rounds(lists: DataFrame, by: list[str], k: int, rounds: int, repeats: bool = False) -> DataFrame:
    """One list per asked vector from those of the rounds 0, 1, …: so many at a time, whatever their number."""
    while rounds > _MERGE:
        lists = lists.withColumn("_round", F.floor(F.col("_round") / _MERGE)).groupBy(*by, "_qid", "_round").agg(_merged(k, repeats))
        rounds = -(-rounds // _MERGE)
    return lists.groupBy(*by, "_qid").agg(_merged(k, repeats))


def _compared(
    asked: DataFrame, known: DataFrame, by: list[str], k: int, metric: str, block: int, repeats: bool = False
) -> tuple[DataFrame, int]:
    """The ``k`` nearest of every asked vector in the cells that it is in, and how many pairs of blocks that took.

    With ``repeats`` two vectors may share several cells.
    """
    # Blocks per cell, on either side.
    blocks = asked.groupBy(*by, "_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_qn"))
    received = known.groupBy(*by, "_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_cn"))
    # The blocks of a group's cells are numbered through; one row per cell.
    before = F.sum("_cn").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    blocks = join_null_safe(blocks, received, [*by, "_cell"]).withColumn("_first", F.coalesce(before, F.lit(0)))
    blocks = freeze(blocks, "blocks")
    total = blocks.agg(F.sum(F.col("_qn").cast("long") * F.col("_cn")).alias("pairs"), F.max(F.col("_first") + F.col("_cn")).alias("most")).first()

    def blocked(rows: DataFrame, own: str, own_n: str, own_id: str, other: str, other_n: str) -> DataFrame:
        out = attach(rows, blocks, [*by, "_cell"], frozen=True)
        out = out.withColumn(own, F.pmod(F.xxhash64(own_id), F.col(own_n)).cast("int"))
        out = out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
        return out.drop(own_n, other_n).withColumn("_g", group_key(by))

    left = blocked(asked, "_qb", "_qn", "_qid", "_cb", "_cn").withColumn("_round", F.col("_first") + F.col("_cb")).drop("_first")
    right = blocked(known, "_cb", "_cn", "_vid", "_qb", "_qn").drop(*by, "_first")
    keys = ["_g", "_cell", "_qb", "_cb"]
    schema = f"{fields(left, [*by, '_qid', '_round'])}, d array<double>, vid array<bigint>, m array<bigint>"

    def compare(these: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        out = these[[*by, "_qid", "_round"]].reset_index(drop=True)
        if not len(these) or not len(those):
            nothing = pd.Series(dtype=object)
            return out.head(0).assign(d=nothing, vid=nothing, m=nothing)
        vid, m = those["_vid"].to_numpy(), those["_m"].to_numpy()
        places, d = _best(matrix(these["_x"]), matrix(those["_x"]), vid, k, metric)
        return out.assign(d=list(d), vid=list(vid[places]), m=list(m[places]))

    left, right = spread(left, *keys), spread(right, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)
    out = found.select(*by, "_qid", "_round", F.arrays_zip("d", "vid", "m").alias("_near"))
    return _merged_in_rounds(out, by, k, total["most"] or 1, repeats), total["pairs"] or 0


def _pivots(known: DataFrame, by: list[str], block: int) -> DataFrame:
    """About one vector in ``block``, at most as many per group as the setting allows, chosen by hash."""
    most = setting(known.sparkSession, "pivots")
    sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    draw = uniform(7, "pivot", *by, "_vid")
    pool = (
        attach(known, sizes, by)
        .where(draw < sample_rate(most, F.col("_n")))
        .select(group_key(by).alias("_g"), *by, "_n", draw.alias("_draw"), "_x")
    )

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        wanted = min(most, -(-int(group["_n"].iloc[0]) // block))
        # Draw order within a head of the pool keeps the choice uniform.
        chosen = group.sort_values("_draw").head(wanted)
        return chosen[[*by, "_x"]].assign(_cell=np.arange(len(chosen), dtype="int32"))[[*by, "_cell", "_x"]]

    schema = ", ".join([*([fields(known, by)] if by else []), "_cell int", "_p array<double>"])
    return pool.groupBy("_g").applyInPandas(lambda g: choose(g).rename(columns={"_x": "_p"}), schema)


def _to_pivots(x: np.ndarray, model: dict[str, Any], metric: str) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(model["_cell"])
    pivots = np.array([model["_p"][i] for i in order], dtype=float)
    return np.asarray(model["_cell"])[order], METRICS[metric](x, pivots)


def _placed(rows: DataFrame, by: list[str], pivots: DataFrame, metric: str, pivot_bytes: int) -> DataFrame:
    """Rows with their cell and the distance ``_d`` from its pivot."""

    def place(x: np.ndarray, model: dict[str, Any]) -> np.ndarray:
        cells, d = _to_pivots(x, model, metric)
        at = d.argmin(axis=1)
        return np.column_stack([cells[at], d[np.arange(len(x)), at]])

    out = apply_models(rows, by, "_x", pivots, place, "_at", pivot_bytes, returns="array<double>")
    out = out.where(F.col("_at").isNotNull())
    return freeze(out.select(*rows.columns, F.col("_at")[0].cast("int").alias("_cell"), F.col("_at")[1].alias("_d")), "cells")


def _within(metric: str) -> Callable:
    """The bundles with another cell that may hold a vector within a row's bound; a row ends in bound, own distance and own cell."""

    def bundles_within(x: np.ndarray, model: dict[str, Any]) -> list:
        bound, own, home = x[:, -3], x[:, -2], x[:, -1]
        cells, d = _to_pivots(x[:, :-3], model, metric)
        order = np.argsort(model["_cell"])
        radius, low, high = (np.asarray(model[c], dtype=float)[order] for c in ("_radius", "_low", "_high"))
        least = np.maximum(d - radius[None, :], (d - own[:, None]) / 2)
        slack = _SLACK * (1 + d + radius[None, :])
        wanted = (least <= bound[:, None] + slack) & (cells[None, :] != home[:, None])
        hit = np.zeros((len(x), int(high.max()) + 1), dtype=bool)
        for at in range(len(cells)):
            hit[wanted[:, at], int(low[at]) : int(high[at]) + 1] = True
        return np.split(np.nonzero(hit)[1].astype(float), np.cumsum(hit.sum(axis=1))[:-1])

    return bundles_within


def _best(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``a`` the places and distances of its ``k`` nearest rows of ``b``, or of all if they are fewer."""
    k = min(k, len(b))
    places, distances = np.empty((len(a), k), dtype=np.int64), np.empty((len(a), k))
    squares = (b * b).sum(axis=1)
    step = _rows_at_once(len(b))
    for start in range(0, len(a), step):
        part = a[start : start + step]
        if metric == "euclidean" and len(b) > 4 * k:
            # A matrix product screens the candidates; the few left are measured exactly.
            own = (part * part).sum(axis=1)[:, None]
            rough = own + squares[None, :] - 2 * part @ b.T
            slack = 1e-10 * (own + squares.max())
            row, column = np.nonzero(rough <= np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + slack)
        else:
            row, column = np.divmod(np.arange(len(part) * len(b)), len(b))
        count = np.bincount(row, minlength=len(part))
        turn = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        d = np.full((len(part), count.max()), np.inf)
        at = np.zeros(d.shape, dtype=np.int64)
        at[row, turn] = column
        d[row, turn] = PAIRED[metric](part[row], b[column])
        order = np.lexsort((ids[at], d), axis=1)[:, :k]
        places[start : start + step] = np.take_along_axis(at, order, axis=1)
        distances[start : start + step] = np.take_along_axis(d, order, axis=1)
    return places, distances


def _rows_at_once(others: int) -> int:
    """Asked rows of which all distances to so many others are held."""
    return max(1, min(256, 256 * _PIECE // max(others, 1)))


def _best_within(
    a: np.ndarray, home: np.ndarray, bound: np.ndarray, b: np.ndarray, cell: np.ndarray, ids: np.ndarray, k: int, metric: str
) -> tuple[np.ndarray, np.ndarray]:
    """Like ``_best``, but of the rows of ``b`` in other cells than ``home`` that are within the bound; places are -1 where
    there are no more. ``b`` lies in the order of ``cell``. What is found lowers the bound of a row for the cells after.
    """
    places, distances = np.full((len(a), k), -1, dtype=np.int64), np.full((len(a), k), np.inf)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    pieces = [(s, min(s + _PIECE, e)) for f, e in zip(starts, np.r_[starts[1:], len(b)]) for s in range(f, e, _PIECE)]
    squares = (b * b).sum(axis=1)
    middles = np.stack([b[s:e].mean(axis=0) for s, e in pieces])
    radius = np.array([METRICS[metric](b[s:e], c[None, :]).max() for (s, e), c in zip(pieces, middles)])
    for start in range(0, len(a), 256):
        rows = slice(start, start + 256)
        part, own, limit = a[rows], (a[rows] * a[rows]).sum(axis=1), bound[rows].copy()
        # Views, which are filled below.
        at, d = places[rows], distances[rows]
        far = METRICS[metric](part, middles)
        slack = _SLACK * (1 + far + radius[None, :])
        for piece in np.argsort(far.mean(axis=0), kind="stable"):
            s, e = pieces[piece]
            asks = np.flatnonzero((far[:, piece] - radius[piece] <= limit + slack[:, piece]) & (home[rows] != cell[s]))
            if not len(asks):
                continue
            if metric == "euclidean":
                # A matrix product screens the candidates; the few left are measured exactly.
                rough = own[asks, None] + squares[None, s:e] - 2 * part[asks] @ b[s:e].T
                room = 1e-10 * (own[asks] + squares[s:e].max())
                most = limit[asks] ** 2 + room
            else:
                rough, room, most = METRICS[metric](part[asks], b[s:e]), 0.0, limit[asks]
            inside = rough <= most[:, None]
            if e - s > k and np.count_nonzero(inside) > 4 * k * len(asks):
                # The bound lets too many in: no more than the k nearest of the piece and their equals.
                most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1] + room)
                inside = rough <= most[:, None]
            row, column = np.nonzero(inside)
            if not len(row):
                continue
            count = np.bincount(row, minlength=len(asks))
            turn = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            more, there = np.full((len(asks), count.max()), np.inf), np.full((len(asks), count.max()), -1, dtype=np.int64)
            more[row, turn] = PAIRED[metric](part[asks[row]], b[s + column])
            there[row, turn] = s + column
            more, there = np.concatenate([d[asks], more], axis=1), np.concatenate([at[asks], there], axis=1)
            order = np.lexsort((ids[there], there < 0, more), axis=1)[:, :k]
            d[asks], at[asks] = np.take_along_axis(more, order, axis=1), np.take_along_axis(there, order, axis=1)
            limit = np.minimum(limit, d[:, k - 1])
    return places, distances


def _projections(x: np.ndarray, model: dict[str, Any], tables: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per table: its number of bits, the projections of the centred vectors, and the cells of these."""
    bits, mean = int(model["_bits"][0]), np.asarray(model["_mean"][0], dtype=float)
    for t in range(tables):
        along = np.random.default_rng([seed, t]).normal(size=(len(mean), bits))
        y = (x - mean) @ along
        yield bits, y, (t << bits) + (y > 0) @ (1 << np.arange(bits))


def _probed(y: np.ndarray, cells: np.ndarray, probes: int) -> np.ndarray:
    """The cells that a vector is most likely to share with near ones: its own, and those across the sides
    that it lies closest to, up to three of them at a time."""
    bits = y.shape[1]
    near = np.argsort(np.abs(y), axis=1)[:, : min(bits, 8)]
    flips = [f for n in range(4) for f in combinations(range(near.shape[1]), n)]
    cost = np.stack([(np.take_along_axis(y, near[:, list(f)], axis=1) ** 2).sum(axis=1) for f in flips], axis=1)
    turned = np.stack([(1 << near[:, list(f)]).sum(axis=1) for f in flips], axis=1).astype(np.int64)
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return cells[:, None] ^ np.take_along_axis(turned, best, axis=1)


def approximate(
    asked: DataFrame, known: DataFrame, by: Sequence[str], k: int, metric: str, tables: int, probes: int, cell_rows: int,
    seed: int, block: int | None = None, counts: dict[str, int] | None = None,
) -> DataFrame:
    """Like ``nearest``, but of the known vectors that share a cell with the asked one in some table.

    A cell is the sides on which a vector lies of random planes through the mean of its group, so many planes that a
    cell has about ``cell_rows`` rows. Known vectors are in one cell of each of ``tables`` tables; an asked one looks into
    ``probes`` cells of each. Cells of any size are compared whole, in blocks.
    """
    by = list(by)
    asked = asked.select(*by, F.col("_vid").alias("_qid"), "_x")
    parts = known.select(*by, F.posexplode("_x").alias("_i", "_c"))
    means = parts.groupBy(*by, "_i").agg(F.avg("_c").alias("_c"), F.count(F.lit(1)).alias("_n"))
    planes = F.greatest(F.ceil(F.log2(F.max("_n") / F.lit(cell_rows))), F.lit(1)).cast("int")
    # One row per group, as long as a vector.
    places = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_c"))), lambda c: c["_c"])
    models = freeze(means.groupBy(*by).agg(places.alias("_mean"), planes.alias("_bits")), "planes")
    size = 16 * (known.select(F.max(F.size("_x")).alias("p")).first()["p"] or 0) + 64

    def own(x: np.ndarray, model: dict[str, Any]) -> np.ndarray:
        return np.stack([cells for _, _, cells in _projections(x, model, tables, seed)], axis=1).astype(float)

    def looked(x: np.ndarray, model: dict[str, Any]) -> np.ndarray:
        return np.concatenate([_probed(y, cells, probes) for _, y, cells in _projections(x, model, tables, seed)], axis=1).astype(float)

    def celled(rows: DataFrame, kernel: Callable, label: str) -> DataFrame:
        out = apply_models(rows, by, "_x", models, kernel, "_cells", size, returns="array<double>")
        return freeze(out.withColumn("_cell", F.explode(F.col("_cells").cast("array<bigint>"))).drop("_cells"), label)

    block = block or setting(asked.sparkSession, "blockRows")
    found, n = _compared(celled(asked, looked, "probes"), celled(known, own, "cells"), by, k, metric, block, repeats=True)
    if counts is not None:
        counts["probed"] = n
    return found


def knn_join(
    asked: DataFrame, known: DataFrame, k: int, by: Sequence[str] = (), key: str = "row_key", vector: str = "features",
    metric: str = "euclidean", block: int | None = None, counts: dict[str, int] | None = None, exact: bool = True,
    tables: int = 16, probes: int = 8, cell_rows: int = 512, seed: int = 42,
) -> DataFrame:
    """The ``k`` nearest rows of ``known`` for every row of ``asked``: ``by``, ``key``, ``rank``, ``neighbour``, ``distance``.

    ``key`` is an integer that tells the rows of a group apart. Rows without a vector take no part; a row that is in both
    tables is its own neighbour. Equal distances go by key. Without ``exact`` the nearest are sought in cells of random
    planes (``approximate``): distances are exact, neighbours may be missed.
    """
    if k < 1 or metric not in METRICS:
        raise ValueError(f"k must be at least 1 and metric one of {sorted(METRICS)}")
    by = list(by)

    def told(df: DataFrame) -> DataFrame:
        x = F.col(vector).cast("array<double>")
        return freeze(df.where(x.isNotNull()).select(*by, F.col(key).cast("long").alias("_vid"), F.lit(1).cast("long").alias("_m"), x.alias("_x")), "told")

    rows = told(known)
    questions = rows if asked is known else told(asked)
    if exact:
        near = nearest(questions, rows, by, k, metric, block, counts)
    else:
        near = approximate(questions, rows, by, k, metric, tables, probes, cell_rows, seed, block, counts)
    listed = near.select(*by, F.col("_qid").alias(key), F.posexplode("_near").alias("rank", "_c"))
    return listed.select(*by, key, (F.col("rank") + 1).alias("rank"), F.col("_c.vid").alias("neighbour"), F.col("_c.d").alias("distance"))
