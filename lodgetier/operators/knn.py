"""Tier of an area by its nearest labelled listings: exact, without comparing all pairs.

Locations, not rows, are searched: rows at one location share their neighbours, and no search
can use more than the first k labelled rows of a location, so both sides shrink first without
changing any result. That also takes the weight out of places where very many rows coincide.

1. Blocks. A grid is laid so that a cell typically holds a handful of points. A search looks at
   its own cell and the eight around it, and is settled if the k-th neighbour found is nearer
   than the edge of that block. Cells holding more than CELL_POINTS are left out, and searches
   that touch one are passed on.
2. Descent, for whatever is left (sparse surroundings, crowded cells). Searches walk down a
   hierarchy of cell counts. At every level the counts alone give a radius that must hold k
   points, and cells beyond it are dropped, so each search keeps a handful of cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgetier.constants import ID, NEIGHBOURS, TARGET, TIERS
from lodgetier.runtime import HOT_KEYS, materialise, ship, spread_join

DEPTH = 40  # finest grid: 2**40 cells per axis
CELL_POINTS = 128
TYPICAL_POINTS = 9
SAMPLE_POINTS = 20_000
STEP = 2  # levels per step of the descent: 4 x 4 children per cell
SLACK = 1e-9  # keeps rounding in cell edges on the safe side

TILE = 5  # levels between a tile and its cells: 32 x 32 cells
TILE_SEARCHES = 100_000  # searches of a tile in one part
HELD_PAIRS = 1 << 18  # distances measured at a time
_CROWDED, _POINT, _SEARCH = range(3)


@dataclass(frozen=True)
class Grid:
    """Square cells over the extent of all points; level 0 is one cell, each level halves them."""

    x0: float
    y0: float
    size: float

    def index(self, value: Column, start: float) -> Column:
        fraction = (value - F.lit(start)) / F.lit(self.size)
        return F.least(F.floor(fraction * F.lit(float(1 << DEPTH))), F.lit((1 << DEPTH) - 1)).cast("bigint")

    def width(self, level: int) -> float:
        return self.size / (1 << level)


def knn_tier(
    train: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, fold: str | None = None, key: str = ID
) -> DataFrame:
    """Add geo_tier to `queries`: distance-weighted vote of the k nearest rows of `train`.

    Missing coordinates count as 0. Neighbours are ordered by distance, then id. At distance zero
    only coinciding rows vote; a tied vote goes to the lowest tier. With `fold`, rows of the same
    fold are not neighbours.
    """
    points, searches = _places(train, fold, k, key), _locations(queries, fold)
    grid, levels = _survey(points, searches)
    found = searches.limit(0).withColumn("geo_tier", F.lit(None).cast("int"))
    for level in levels:
        settled, searches = _search_tiles(points, searches, grid, level, k)
        found = found.unionByName(settled)
        if searches.isEmpty():
            break
    if not searches.isEmpty():
        found = found.unionByName(_descend(points, searches, grid, k))
    located = queries.withColumns(
        {"_x": _coordinate("latitude"), "_y": _coordinate("longitude"), "_f": _fold(fold, -2)}
    )
    return spread_join(located, found, ["_x", "_y", "_f"]).select(*queries.columns, "geo_tier")


def knn_tier_out_of_fold(df: DataFrame, k: int = NEIGHBOURS, fold: str = "fold", key: str = ID) -> DataFrame:
    """Add geo_tier from the rows of all other folds, so that no row sees its own tier."""
    return knn_tier(df, df, k, fold, key)


def _coordinate(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0)) + F.lit(0.0)


def _fold(fold: str | None, otherwise: int) -> Column:
    return F.col(fold).cast("int") if fold else F.lit(otherwise)


def _places(train: DataFrame, fold: str | None, k: int, key: str) -> DataFrame:
    """Labelled points: the k lowest ids of every location and fold, with their finest cell."""
    points = train.where(F.col(TARGET).isNotNull()).select(
        _coordinate("latitude").alias("px"),
        _coordinate("longitude").alias("py"),
        _fold(fold, -1).alias("pf"),
        F.col(key).alias("pid"),
        F.col(TARGET).cast("int").alias("tier"),
    )
    # Spark limits each group inside every task before the shuffle, so a crowded location is cheap.
    first = Window.partitionBy("px", "py", "pf").orderBy("pid", "tier")
    return materialise(points.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n"), "points")


def _locations(queries: DataFrame, fold: str | None) -> DataFrame:
    return materialise(
        queries.select(
            _coordinate("latitude").alias("_x"), _coordinate("longitude").alias("_y"), _fold(fold, -2).alias("_f")
        ).distinct(),
        "searches",
    )


def _survey(points: DataFrame, searches: DataFrame) -> tuple[Grid, list[int]]:
    """A grid over all points, and the levels at which its cells hold about TYPICAL_POINTS.

    The levels, finest first, suit places of middling, high and low density, and one step coarser
    than middling for what that leaves. They only decide speed and come from a small sample.
    """
    both = points.select("px", "py").union(searches.select("_x", "_y"))
    low_x, high_x, low_y, high_y = both.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if low_x is None:
        return Grid(0.0, 0.0, 1.0), []
    size = max(high_x - low_x, high_y - low_y, 1e-9) * (1 + 1e-6)
    grid = Grid(low_x, low_y, size)
    share = min(1.0, SAMPLE_POINTS / max(points.count(), 1))
    sample = points if share == 1.0 else points.sample(share, seed=1)
    cells = sample.select(grid.index(F.col("px"), grid.x0).alias("cx"), grid.index(F.col("py"), grid.y0).alias("cy"))
    drawn = cells.limit(2 * SAMPLE_POINTS).toPandas()
    if drawn.empty:
        return grid, []
    # Around each sampled point: the smallest cell with enough points to judge the density by, and
    # the width that would hold a typical number at that density.
    level, own = np.zeros(len(drawn), dtype=int), np.full(len(drawn), len(drawn))
    for finer in range(1, DEPTH - 2):
        at = drawn // (1 << (DEPTH - finer))
        size_of = at.groupby(["cx", "cy"]).cx.transform("size").to_numpy()
        enough = size_of >= TYPICAL_POINTS
        if not enough.any():
            break
        level[enough], own[enough] = finer, size_of[enough]
    ideal = size / np.exp2(level) * np.sqrt(TYPICAL_POINTS * share / own)
    middling, dense, thin = (max(w, size / 2.0 ** (DEPTH - 3)) for w in np.quantile(ideal, (0.5, 0.1, 0.9)))
    main = max(1, math.ceil(math.log2(size / middling)))
    grid = Grid(low_x, low_y, max(size, middling * 2.0**main))
    others = {round(math.log2(grid.size / w)) for w in (dense, thin)}
    levels = {main, main - 1, *(x for x in others if abs(x - main) > 1)}
    return grid, sorted((x for x in levels if 0 < x <= DEPTH - 2), reverse=True)


def _cells(df: DataFrame, grid: Grid, level: int, x: str, y: str) -> DataFrame:
    shift = DEPTH - level
    return df.withColumns(
        {
            "cx": F.shiftright(grid.index(F.col(x), grid.x0), shift),
            "cy": F.shiftright(grid.index(F.col(y), grid.y0), shift),
        }
    )


def _distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.pow(F.col("_x") - x, 2) + F.pow(F.col("_y") - y, 2))


def _add_vote(located: DataFrame) -> DataFrame:
    """Replace `near`, the neighbours in order as (d, pid, tier), by what follows from them."""
    votes = [
        F.aggregate(
            F.filter("near", _has_tier(t)),
            F.lit(0.0),
            lambda total, n: total
            + F.when(n["d"] == 0, 1.0).when(F.col("nearest") > 0, 1 / n["d"]).otherwise(0.0),
        )
        for t in TIERS
    ]
    return (
        located.withColumns(
            {
                "n": F.size("near"),
                "nearest": F.get("near", F.lit(0))["d"],
                "farthest": F.try_element_at("near", F.lit(-1))["d"],
            }
        )
        .where("n > 0")
        .withColumn("_votes", F.array(*votes))
        .withColumn("geo_tier", (F.array_position("_votes", F.array_max("_votes")) - 1).cast("int"))
        .drop("near", "_votes")
    )


def _has_tier(tier: int):
    return lambda n: n["tier"] == tier


def _search_tiles(
    points: DataFrame, searches: DataFrame, grid: Grid, level: int, k: int
) -> tuple[DataFrame, DataFrame]:
    """Settle searches inside their 3 x 3 block; returns (settled with geo_tier, the rest).

    Points and searches meet by tile. A point goes to another tile only from a cell on the edge, so that little is
    sent twice. A tile holds a bounded number of points, since crowded cells are left out, and its searches are
    streamed; tiles with very many of them are dealt to several parts.
    """
    bits = min(TILE, level)
    celled = _cells(points.where("pf is not null"), grid, level, "px", "py")
    crowded = materialise(celled.groupBy("cx", "cy").count().where(F.col("count") > CELL_POINTS), "crowded")
    entry = ["px as x", "py as y", "pf as f", "pid", "coalesce(tier, -1) as tier", "cx", "cy"]
    members = celled
    if not crowded.isEmpty():
        # The largest cells go first, by broadcast, so that they never reach a shuffle.
        largest = F.broadcast(crowded.orderBy(F.desc("count")).limit(HOT_KEYS))
        members = celled.join(largest, ["cx", "cy"], "left_anti").join(crowded, ["cx", "cy"], "left_anti")
    members = members.selectExpr(*entry, f"{_POINT} as kind").unionByName(
        crowded.select("cx", "cy", F.lit(_CROWDED).alias("kind")), allowMissingColumns=True
    )
    for tile, cell in (("tx", "cx"), ("ty", "cy")):
        own, inside = F.shiftright(cell, bits), F.col(cell).bitwiseAND(F.lit((1 << bits) - 1))
        before = F.when(inside == 0, F.array(own - 1)).otherwise(F.array().cast("array<bigint>"))
        behind = F.when(inside == (1 << bits) - 1, F.array(own + 1)).otherwise(F.array().cast("array<bigint>"))
        members = members.select("*", F.explode(F.concat(F.array(own), before, behind)).alias(tile))
    asked = _cells(searches, grid, level, "_x", "_y").selectExpr(
        "_x as x", "_y as y", "_f as f", "cx", "cy", f"{_SEARCH} as kind", f"shiftright(cx, {bits}) as tx", f"shiftright(cy, {bits}) as ty"
    )
    counts = asked.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / TILE_SEARCHES).alias("parts"))
    shared = materialise(counts.where("parts > 1"), "tiles")
    if shared.isEmpty():
        members, asked = members.withColumn("part", F.lit(0)), asked.withColumn("part", F.lit(0))
    else:  # a row per `TILE_SEARCHES` searches at most
        parts = F.coalesce("parts", F.lit(1)).cast("int")
        members = members.join(F.broadcast(shared), ["tx", "ty"], "left")
        members = members.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        asked = asked.join(F.broadcast(shared), ["tx", "ty"], "left")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("x", "y", "f"), parts).cast("int")).drop("parts")
    tiles = ["tx", "ty", "part"]
    met = members.unionByName(asked, allowMissingColumns=True).repartition(*tiles)
    # Points of a tile arrive by id and tier, so that their place tells the order of equals.
    met = met.sortWithinPartitions(*tiles, "kind", "pid", "tier").drop("pid")
    ship(points.sparkSession)
    run = partial(_searched, x0=grid.x0, y0=grid.y0, size=grid.size, width=grid.width(level), bits=bits, k=k)
    done = materialise(met.mapInArrow(run, "_x double, _y double, _f int, geo_tier int"), "searched")
    return done.where("geo_tier is not null"), done.where("geo_tier is null").drop("geo_tier")


def _searched(
    batches: Iterator[pa.RecordBatch], x0: float, y0: float, size: float, width: float, bits: int, k: int
) -> Iterator[pa.RecordBatch]:
    """Searches with the tier of their area, null where the block doesn't prove it; tile by tile, points first."""
    tile, held, points = None, [], None
    for batch in batches:
        tx, ty, part, kind = (batch.column(c).to_numpy() for c in ("tx", "ty", "part", "kind"))
        changes = [np.diff(c) != 0 for c in (tx, ty, part, kind)]
        edges = [0, *(np.flatnonzero(np.logical_or.reduce(changes)) + 1).tolist(), len(tx)]
        for start, end in zip(edges, edges[1:]):
            if start == end:
                continue
            if (tx[start], ty[start], part[start]) != tile:
                tile, held, points = (tx[start], ty[start], part[start]), [], None
            rows = batch.slice(start, end - start)
            if kind[start] != _SEARCH:
                held.append((int(kind[start]), rows))
                continue
            points = points or _Tile(held, int(tile[0]), int(tile[1]), bits)
            x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
            cx, cy = rows.column("cx").to_numpy(), rows.column("cy").to_numpy()
            folds = rows.column("f")
            inside_x, inside_y = x - x0 - cx * width, y - y0 - cy * width
            edge = width + np.minimum.reduce([inside_x, width - inside_x, inside_y, width - inside_y])
            reach = np.where(folds.is_valid().to_numpy(zero_copy_only=False), edge * (1 - SLACK) - size * 1e-12, -1.0)
            tier = points.tiers(x, y, folds.fill_null(-3).to_numpy(), cx, cy, reach, k)
            found = pa.array(tier, pa.int32(), mask=tier < 0)
            yield pa.RecordBatch.from_arrays([rows.column("x"), rows.column("y"), folds, found], ["_x", "_y", "_f", "geo_tier"])


class _Tile:
    """The points of a tile and of the cells around it, by cell."""

    def __init__(self, held: list[tuple[int, pa.RecordBatch]], tx: int, ty: int, bits: int):
        self.side = (1 << bits) + 2
        self.low_x, self.low_y = (tx << bits) - 1, (ty << bits) - 1
        columns = {}
        for name in ("x", "y", "f", "tier", "cx", "cy"):
            parts = [rows.column(name).to_numpy() for kind, rows in held if kind == _POINT]
            columns[name] = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        cell = self._cell(columns["cx"], columns["cy"])
        self.place = np.argsort(cell, kind="stable")
        self.x, self.y, self.f, self.tier = (columns[c][self.place] for c in ("x", "y", "f", "tier"))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=self.side**2))])
        crowded = np.zeros((self.side, self.side), dtype=bool)
        for kind, rows in held:
            if kind == _CROWDED:
                crowded.flat[self._cell(rows.column("cx").to_numpy(), rows.column("cy").to_numpy())] = True
        touched = np.zeros_like(crowded)
        for i in range(3):
            for j in range(3):
                touched[1:-1, 1:-1] |= crowded[i : self.side - 2 + i, j : self.side - 2 + j]
        self.touched = touched.ravel()

    def _cell(self, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        return ((cy - self.low_y) * self.side + cx - self.low_x).astype(np.int64)

    def tiers(
        self, x: np.ndarray, y: np.ndarray, f: np.ndarray, cx: np.ndarray, cy: np.ndarray, reach: np.ndarray, k: int
    ) -> np.ndarray:
        """The tier of each search whose k-th neighbour is nearer than `reach`, -1 for the others."""
        cell = self._cell(cx, cy)
        # Points are in order of rows of cells, so a block is three ranges.
        first = np.stack([self.starts[cell + row * self.side - 1] for row in (-1, 0, 1)])
        length = np.stack([self.starts[cell + row * self.side + 2] for row in (-1, 0, 1)]) - first
        total = length.sum(axis=0)
        out = np.full(len(x), -1, dtype=np.int32)
        able = np.flatnonzero((total >= k) & ~self.touched[cell] & (reach > 0))
        step = max(1, HELD_PAIRS // int(total[able].max(initial=1)))
        for start in range(0, len(able), step):
            some = able[start : start + step]
            out[some] = self._tiers(x[some], y[some], f[some], first[:, some], length[:, some], reach[some], k)
        return out

    def _tiers(
        self, x: np.ndarray, y: np.ndarray, f: np.ndarray, first: np.ndarray, length: np.ndarray, reach: np.ndarray, k: int
    ) -> np.ndarray:
        upto = np.cumsum(length, axis=0)[:, :, None]
        at = np.arange(int(upto[2].max()))[None, :]
        shift = first[:, :, None] - np.concatenate([np.zeros_like(upto[:1]), upto[:2]])
        near = at + np.where(at < upto[0], shift[0], np.where(at < upto[1], shift[1], shift[2]))
        usable = at < upto[2]
        near = np.where(usable, near, 0)
        away = np.sqrt((x[:, None] - self.x[near]) ** 2 + (y[:, None] - self.y[near]) ** 2)
        away[~usable | (self.f[near] == f[:, None])] = np.inf
        kth = np.partition(away, k - 1, axis=1)[:, k - 1]
        proven = np.flatnonzero(kth < reach)
        out = np.full(len(x), -1, dtype=np.int32)
        rows, columns = np.nonzero(away[proven] <= kth[proven, None])  # the k nearest and equals of the last
        which, d = near[proven[rows], columns], away[proven[rows], columns]
        order = np.lexsort((self.place[which], d, rows))
        rows = rows[order]
        within = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        d = d[order][within].reshape(-1, k)
        tier = self.tier[which[order][within]].reshape(-1, k)
        weight = np.where(d[:, :1] > 0, 1 / np.where(d > 0, d, 1), d == 0)
        votes = np.zeros((len(d), len(TIERS)))
        for i in range(k):  # in the order of nearness
            for t, name in enumerate(TIERS):
                votes[:, t] += np.where(tier[:, i] == name, weight[:, i], 0.0)
        out[proven] = votes.argmax(axis=1)
        return out


def _descend(points: DataFrame, searches: DataFrame, grid: Grid, k: int) -> DataFrame:
    """Settle every search by walking down the cell hierarchy; the exact way for the rest."""
    search = ["_x", "_y", "_f"]
    level = 0
    open_cells = searches.select(*search, F.lit(0).cast("bigint").alias("cx"), F.lit(0).cast("bigint").alias("cy"))
    leaves = None
    leaf_levels = []
    while True:
        level = min(level + STEP, DEPTH)
        children = _cell_counts(points, grid, level).withColumns(
            {"parent_x": F.shiftright("cx", STEP), "parent_y": F.shiftright("cy", STEP)}
        )
        parents = open_cells.withColumnsRenamed({"cx": "parent_x", "cy": "parent_y"})
        below = spread_join(parents, children, ["parent_x", "parent_y"], "inner").drop("parent_x", "parent_y")
        below = _with_reach(below, grid, level).withColumns(
            {"level": F.lit(level), "leaf": (F.col("points") <= CELL_POINTS) | F.lit(level >= DEPTH)}
        )
        seen = below if leaves is None else below.unionByName(leaves)
        by_reach = Window.partitionBy(*search).orderBy("farthest").rangeBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        enough = F.when(F.sum("usable").over(by_reach) >= k, F.col("farthest"))
        radius = F.min("enough").over(Window.partitionBy(*search))
        kept = materialise(
            seen.withColumn("enough", enough)
            .withColumn("radius", radius)
            .where(F.col("radius").isNull() | (F.col("nearest") <= F.col("radius")))
            .drop("enough", "radius"),
            "cells",
        )
        leaves = kept.where("leaf")
        leaf_levels.append(level)
        open_cells = kept.where("not leaf").select(*search, "cx", "cy")
        if open_cells.isEmpty():
            break
    candidates = None
    for used in leaf_levels:
        pairs = spread_join(
            leaves.where(F.col("level") == used).select(*search, "cx", "cy"),
            _cells(points, grid, used, "px", "py"),
            ["cx", "cy"],
            "inner",
        )
        candidates = pairs if candidates is None else candidates.unionByName(pairs)
    candidates = candidates.where(F.col("pf") != F.col("_f")).withColumn(
        "d", _distance(F.col("px"), F.col("py"))
    )
    order = Window.partitionBy(*search).orderBy("d", "pid", "tier")
    ranked = candidates.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    near = ranked.groupBy(*search).agg(F.sort_array(F.collect_list(F.struct("d", "pid", "tier"))).alias("near"))
    return materialise(_add_vote(near).select(*search, "geo_tier"), "descended")


def _cell_counts(points: DataFrame, grid: Grid, level: int) -> DataFrame:
    """Points per cell, in all and per fold."""
    per_fold = _cells(points, grid, level, "px", "py").groupBy("cx", "cy", "pf").count()
    return per_fold.groupBy("cx", "cy").agg(
        F.sum("count").alias("points"),
        F.map_from_entries(F.collect_list(F.struct("pf", "count"))).alias("by_fold"),
    )


def _with_reach(cells: DataFrame, grid: Grid, level: int) -> DataFrame:
    """Nearest and farthest possible distance from a search to a cell, with rounding allowed for."""
    width = grid.width(level)
    low_x = F.lit(grid.x0) + F.col("cx") * width
    low_y = F.lit(grid.y0) + F.col("cy") * width
    x, y = F.col("_x"), F.col("_y")
    gap_x = F.greatest(low_x - x, x - low_x - width, F.lit(0.0))
    gap_y = F.greatest(low_y - y, y - low_y - width, F.lit(0.0))
    span_x = F.greatest(F.abs(low_x - x), F.abs(low_x + width - x))
    span_y = F.greatest(F.abs(low_y - y), F.abs(low_y + width - y))
    slack = grid.size * 1e-12
    return cells.select(
        "_x",
        "_y",
        "_f",
        "cx",
        "cy",
        "points",
        (F.col("points") - F.coalesce(F.try_element_at("by_fold", "_f"), F.lit(0))).alias("usable"),
        (F.sqrt(gap_x * gap_x + gap_y * gap_y) - slack).alias("nearest"),
        (F.sqrt(span_x * span_x + span_y * span_y) + slack).alias("farthest"),
    )
