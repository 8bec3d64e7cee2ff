"""Hotspot distances, areas by clustering, and area labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgetier.constants import (
    AREA_LABEL_OTHERWISE,
    AREA_LABELS,
    CITY_CENTRE,
    CLUSTER_RESTARTS,
    DEFAULT_CLUSTERS,
    HOTSPOTS,
    SEED,
    TARGET,
)
from lodgetier.runtime import materialise, ship

Centre = tuple[float, float]

#: Sides of the grids that starts are moved on before they meet the data: at most 64 and 256 squared cells.
SIDES = (64, 256)

#: Places between two centres that a pass may bring of a start, and of all where few starts are left; margins are
#: told apart down to 2 ** -FINEST degrees.
BORDER = 20_000
SHARED_BORDER = 100_000
FINEST = 60

#: Passes a start may take; it stops as soon as no centre moves any more.
MOST_ITERATIONS = 300
SETTLED = 1e-8

#: Step below which a start rests on a grid.
RESTED = 1e-7

#: Centres up to which their distances are written out one by one.
WRITTEN_OUT = 5


def degrees_between(lat: Column, lon: Column, centre: Centre) -> Column:
    return F.sqrt(F.pow(lat - F.lit(centre[0]), 2) + F.pow(lon - F.lit(centre[1]), 2))


def hotspot_distances(df: DataFrame) -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.withColumns({f"dist_{name}": degrees_between(lat, lon, at) for name, at in HOTSPOTS.items()})


def nearest_centre(lat: Column, lon: Column, centres: Sequence[Centre]) -> Column:
    """Index of the nearest centre, the first one on ties; null without coordinates.

    The centres are part of the expression, so assigning areas is a projection, not a join. Many centres are gone
    through in a loop: written out, they would make a method that is too long to be compiled.
    """
    if len(centres) > WRITTEN_OUT:
        listed = F.array(*[F.struct(F.lit(float(y)).alias("lat"), F.lit(float(x)).alias("lon")) for y, x in centres])
        distances = F.transform(listed, lambda c: F.sqrt(F.pow(lat - c["lat"], 2) + F.pow(lon - c["lon"], 2)))
        nearest = F.get(F.transform(F.array(distances), lambda d: F.array_position(d, F.array_min(d))), F.lit(0)) - 1
    else:
        distances = F.array(*[degrees_between(lat, lon, c) for c in centres])
        nearest = F.array_position(distances, F.array_min(distances)) - 1
    return F.when(lat.isNotNull() & lon.isNotNull(), nearest.cast("int"))


def tier_label(mean_tier: Column) -> Column:
    """Label of a mean tier; null and anything outside the bins is the luxury label."""
    bins = [((mean_tier >= low) & (mean_tier < high), label) for low, high, label in AREA_LABELS]
    chain = reduce(lambda chosen, b: chosen.when(b[0], b[1]), bins, F)
    return chain.otherwise(AREA_LABEL_OTHERWISE)


def cluster_summary(df: DataFrame, n_clusters: int, cluster: str = "cluster") -> DataFrame:
    """Mean tier, rows, mean position and label per cluster; clusters without rows are listed with n = 0."""
    found = df.groupBy(cluster).agg(
        F.avg(TARGET).alias("mean_tier"),
        F.count(F.lit(1)).alias("n"),
        F.avg("latitude").alias("mean_lat"),
        F.avg("longitude").alias("mean_lon"),
    )
    ids = df.sparkSession.range(n_clusters).select(F.col("id").cast("int").alias(cluster))
    return (
        ids.join(found, cluster, "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("geo_label", tier_label(F.col("mean_tier")))
    )


@dataclass(frozen=True)
class AreaModel:
    """Cluster centres with one label each; a few dozen values whatever the table size."""

    centres: tuple[Centre, ...]
    labels: tuple[str, ...]

    def cluster(self, lat: Column, lon: Column) -> Column:
        return nearest_centre(lat, lon, self.centres)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add geo_label; a listing without coordinates is taken to be in the city centre."""
        lat, lon = (
            F.coalesce(F.col(c).cast("double"), F.lit(centre)) if c in df.columns else F.lit(centre)
            for c, centre in zip(("latitude", "longitude"), CITY_CENTRE)
        )
        found = self.cluster(lat, lon)
        labels = F.array(*[F.lit(label) for label in self.labels])
        return df.withColumn("geo_label", F.get(labels, found))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, *self.centres[i], label) for i, label in enumerate(self.labels)]
        spark.createDataFrame(rows, "cluster int, lat double, lon double, geo_label string").coalesce(
            1
        ).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> AreaModel:
        rows = spark.read.parquet(path).orderBy("cluster").collect()
        return AreaModel(tuple((r.lat, r.lon) for r in rows), tuple(r.geo_label for r in rows))


def fit_centres(
    df: DataFrame, k: int = DEFAULT_CLUSTERS, restarts: int = CLUSTER_RESTARTS, seed: int = SEED
) -> list[Centre]:
    """k-means on the coordinates, the best of several starts."""
    return fit_all_centres(df, (k,), restarts, seed)[k]


def fit_all_centres(
    df: DataFrame, counts: Sequence[int], restarts: int = CLUSTER_RESTARTS, seed: int = SEED
) -> dict[int, list[Centre]]:
    """For each number of centres the best of several starts; all starts share their passes over the data.

    Rows at one place become one weighted point. Starts are drawn from the cells of a coarse grid, which have the
    weights and means of their places, and moved until they rest on it and on a finer one; equal ones are one
    from then on. A pass over all places then assigns every place under every open start and adds up weights,
    coordinates and costs by (start, centre); starts whose centres no longer move drop out.

    A pass also brings the `BORDER` places or fewer of a start that lie closest between two centres. No other
    place can change its centre until some centre has moved by half the width of that border, so steps up to
    there are taken on these alone, with the same result as one pass each.
    """
    places = df.select(F.col("latitude").cast("double"), F.col("longitude").cast("double")).dropna()
    places = places.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("weight"))
    places = materialise(places, "places")
    grids, widths = _grids(places)
    if not len(grids[0]):
        raise ValueError("no coordinates to fit centres on")
    # Starts with the most centres take longest and come first.
    open_starts = [_drawn(grids[0], k, np.random.default_rng([seed, k, i])) for k in sorted(set(counts), reverse=True) for i in range(restarts)]
    for cells, sides in zip(grids, widths):
        rested = _all_rested(df.sparkSession, cells, open_starts, sides)
        open_starts = list({np.round(centres, 7).tobytes(): centres for centres in rested}.values())
    best: dict[int, tuple[float, np.ndarray]] = {}
    edges = [0.0] * len(open_starts)
    for _ in range(MOST_ITERATIONS):
        moving, left = [], []
        for start in _passed(places, open_starts, edges):
            after, cost, rested = start.moved()
            if rested and (len(after) not in best or cost < best[len(after)][0]):
                best[len(after)] = (cost, after)
            if not rested:
                moving.append(after)
                left.append(start)
        most = max(BORDER, SHARED_BORDER // max(len(left), 1))
        open_starts, edges = moving, [start.next_edge(most) for start in left]
        if not moving:
            break
    for centres in open_starts:  # still moving after the last pass
        best.setdefault(len(centres), (np.inf, centres))
    return {k: sorted((float(lat), float(lon)) for lat, lon in best[k][1]) for k in counts}


def _grids(places: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(weight, latitude, longitude) of the cells of grids over all places, and their sides; the coarsest first."""
    side = SIDES[-1]
    lat, lon = F.col("latitude"), F.col("longitude")
    low_lat, high_lat, low_lon, high_lon = places.agg(F.min(lat), F.max(lat), F.min(lon), F.max(lon)).first()
    if low_lat is None:
        return [np.zeros((0, 3))], [np.zeros(2)]

    def cell(value: Column, low: float, high: float) -> Column:
        width = (high - low) / side or 1.0
        return F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(side - 1))

    grid = places.groupBy(cell(lat, low_lat, high_lat).alias("y"), cell(lon, low_lon, high_lon).alias("x")).agg(
        F.sum("weight").alias("n"), F.sum(lat * F.col("weight")).alias("lat"), F.sum(lon * F.col("weight")).alias("lon")
    )
    rows = np.array(sorted(tuple(r) for r in grid.collect()), dtype=float)  # the finest grid's cells at most
    found = []
    for other in SIDES:
        name = rows[:, 0] * other // side * other + rows[:, 1] * other // side
        _, which = np.unique(name, return_inverse=True)
        n, *sums = (np.bincount(which, rows[:, i]) for i in (2, 3, 4))
        found.append(np.column_stack([n, *(s / n for s in sums)]))
    return found, [np.array([high_lat - low_lat, high_lon - low_lon]) / other for other in SIDES]


def _drawn(cells: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k cells drawn one after the other, by weight times the squared distance to those drawn before."""
    chosen = [cells[rng.choice(len(cells), p=cells[:, 0] / cells[:, 0].sum()), 1:]]
    for _ in range(k - 1):
        away = np.min([((cells[:, 1:] - c) ** 2).sum(axis=1) for c in chosen], axis=0) * cells[:, 0]
        total = away.sum()
        chosen.append(cells[rng.choice(len(cells), p=away / total) if total > 0 else rng.integers(len(cells)), 1:])
    return np.array(chosen)


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, the first of equals, and the squared distance to it."""
    best = np.full(len(points), np.inf)
    which = np.zeros(len(points), dtype=np.int64)
    for i, (lat, lon) in enumerate(centres):
        away = (points[:, 0] - lat) ** 2 + (points[:, 1] - lon) ** 2
        nearer = away < best
        best[nearer], which[nearer] = away[nearer], i
    return which, best


def _sums(points: np.ndarray, weight: np.ndarray, centres: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """Weight, coordinates relative to the centre, and cost of the points of each centre."""
    which = _nearest(points, centres)[0] if which is None else which
    inside = points - centres[which]
    columns = (weight, weight * inside[:, 0], weight * inside[:, 1], weight * (inside**2).sum(axis=1))
    return np.column_stack([np.bincount(which, c, minlength=len(centres)) for c in columns])


def _two_nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest and the second nearest centre of each point, and the squared distances to them."""
    best, second = np.full(len(points), np.inf), np.full(len(points), np.inf)
    which, other = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=np.int64)
    for i, (lat, lon) in enumerate(centres):
        away = (points[:, 0] - lat) ** 2 + (points[:, 1] - lon) ** 2
        nearer, between = away < best, away < second
        other = np.where(nearer, which, np.where(between, i, other))
        second = np.where(nearer, best, np.where(between, away, second))
        which, best = np.where(nearer, i, which), np.where(nearer, away, best)
    return which, other, best, second


@dataclass
class _Start:
    """What a pass has found for some centres: sums of places off the border, places on it, margins of all."""

    centres: np.ndarray
    edge: float
    sums: np.ndarray
    margins: np.ndarray
    points: np.ndarray
    weight: np.ndarray

    def moved(self) -> tuple[np.ndarray, float, bool]:
        """Centres after as many steps as the border allows, their cost, and whether they rest."""
        now = self.centres.copy()
        while True:
            shift = now - self.centres  # sums relative to centres that have moved since
            sums = self.sums.copy()
            sums[:, 1:3] -= sums[:, :1] * shift
            sums[:, 3] += (-2 * self.sums[:, 1:3] * shift).sum(axis=1) + self.sums[:, 0] * (shift**2).sum(axis=1)
            if len(self.points):
                sums += _sums(self.points, self.weight, now)
            held = sums[:, :1] > 0
            after = np.where(held, now + sums[:, 1:3] / np.where(held, sums[:, :1], 1), now)  # a centre without places stays
            if np.abs(after - now).max() <= SETTLED:
                return now, float(sums[:, 3].sum()), True
            if np.sqrt(((after - self.centres) ** 2).sum(axis=1)).max() >= self.edge / 2:
                return after, np.inf, False
            now = after

    def next_edge(self, most: int) -> float:
        """The widest border that holds `most` places or fewer, as far as the margins tell."""
        below = np.cumsum(self.margins[::-1])[::-1]  # places with a margin under 2 ** -j
        fits = np.flatnonzero(below <= most)
        return 2.0 ** -int(fits[0]) if len(fits) else 0.0


def _passed(places: DataFrame, starts: list[np.ndarray], edges: list[float]) -> list[_Start]:
    """One pass over all places for every start and the width of its border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(c), 4)) for c in starts]
        margins = [np.zeros(FINEST) for _ in starts]
        for batch in batches:
            points = np.asfortranarray(np.column_stack([batch.column(c).to_numpy() for c in ("latitude", "longitude")]))
            weight = batch.column("weight").to_numpy().astype(float)
            for i, (centres, edge) in enumerate(zip(starts, edges)):
                which, _, best, second = _two_nearest(points, centres)
                margin = np.sqrt(second) - np.sqrt(best)
                power = np.clip(np.floor(-np.log2(np.maximum(margin, 1e-300))), 0, FINEST - 1).astype(np.int64)
                margins[i] += np.bincount(power[margin < 1], minlength=FINEST)
                on = margin < edge
                totals[i] += _sums(points[~on], weight[~on], centres, which[~on])
                if on.any():
                    n = int(on.sum())
                    yield rows(i, np.full(n, -1), points[on], weight[on], np.zeros((n, 3)))
        for i, (total, counts) in enumerate(zip(totals, margins)):
            yield rows(i, np.arange(len(total)), np.zeros((len(total), 2)), total[:, 0], total[:, 1:])
            yield rows(i, -2 - np.arange(FINEST), np.zeros((FINEST, 2)), counts, np.zeros((FINEST, 3)))

    def rows(start: int, what: np.ndarray, points: np.ndarray, n: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(what), start), what, *points.T, n, *more.T]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    names = ["start", "what", "y", "x", "n", "lat", "lon", "cost"]
    ship(places.sparkSession)
    parts = places.mapInArrow(run, "start long, what long, y double, x double, n double, lat double, lon double, cost double")
    found = parts.groupBy(*names[:4]).agg(*(F.sum(c).alias(c) for c in names[4:])).toArrow()  # centres, margins and borders
    start, what, y, x, n, lat, lon, cost = (found.column(c).to_numpy() for c in names)
    out = []
    for i, (centres, edge) in enumerate(zip(starts, edges)):
        sums, margins = np.zeros((len(centres), 4)), np.zeros(FINEST)
        at = np.flatnonzero((start == i) & (what >= 0))
        sums[what[at]] = np.column_stack([n[at], lat[at], lon[at], cost[at]])
        at = np.flatnonzero((start == i) & (what < -1))
        margins[-2 - what[at]] = n[at]
        at = np.flatnonzero((start == i) & (what == -1))
        out.append(_Start(centres, edge, sums, margins, np.column_stack([y[at], x[at]]), n[at]))
    return out


def _rested(cells: np.ndarray, centres: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Centres at rest on cells whose weight is spread evenly over them.

    A cell between two centres is shared by them, so that centres don't stop short where a small step takes no
    whole cell across; that would leave the way on to passes over the data. Only cells near a border are looked at
    again while the centres move by less than `near`. Since cells are shared by two centres only, centres may go round
    in circles; they rest where they come back to.
    """
    near = max(4 * float(np.hypot(*sides)), 1e-9)
    centres, met = centres.copy(), set()
    for _ in range(MOST_ITERATIONS):
        which, _, best, second = _two_nearest(cells[:, 1:], centres)
        on = np.sqrt(second) - np.sqrt(best) < 2 * near
        inner = _moments(cells[~on], which[~on], len(centres))
        border, start, settled = cells[on], centres, False
        for _ in range(MOST_ITERATIONS):
            if settled or np.sqrt(((centres - start) ** 2).sum(axis=1)).max() >= near / 2:
                break
            sums = inner + _shared(border, centres, sides)
            held = sums[:, :1] > 0
            after = np.where(held, sums[:, 1:] / np.where(held, sums[:, :1], 1), centres)
            place = np.round(after / RESTED).tobytes()
            settled = np.abs(after - centres).max() <= RESTED or place in met
            met.add(place)
            centres = after
        if settled:
            break
    return centres[np.lexsort(centres.T[::-1])]


def _all_rested(spark: SparkSession, cells: np.ndarray, starts: list[np.ndarray], sides: np.ndarray) -> list[np.ndarray]:
    """Each start at rest on the cells; a start is a task."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [_rested(cells, starts[i], sides).tobytes() for i in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(data, pa.binary())], ["id", "centres"])

    found = spark.range(0, len(starts), 1, len(starts)).mapInArrow(run, "id long, centres binary").collect()  # some centres a start
    return [np.frombuffer(bytes(r.centres)).reshape(-1, 2) for r in sorted(found, key=lambda r: r.id)]


def _moments(cells: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    """Weight and weighted coordinates by centre."""
    columns = (cells[:, 0], cells[:, 0] * cells[:, 1], cells[:, 0] * cells[:, 2])
    return np.column_stack([np.bincount(which, c, minlength=k) for c in columns])


def _shared(cells: np.ndarray, centres: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """As `_moments`, with a cell's part beyond the middle between its two nearest centres given to the second."""
    which, other, best, second = _two_nearest(cells[:, 1:], centres)
    sums = _moments(cells, which, len(centres))
    if len(centres) == 1:
        return sums
    across = centres[other] - centres[which]
    apart = np.sqrt((across**2).sum(axis=1))
    across /= np.maximum(apart, 1e-300)[:, None]
    half = np.abs(across) @ sides / 2  # of the cell's extent from one centre to the other
    to_middle = (second - best) / np.maximum(2 * apart, 1e-300)
    cut = (to_middle < half) & (apart > 0)
    half, to_middle = half[cut], to_middle[cut]
    moved = cells[cut].copy()
    moved[:, 0] *= (half - to_middle) / (2 * half)
    moved[:, 1:] += across[cut] * ((half + to_middle) / 2)[:, None]
    return sums - _moments(moved, which[cut], len(centres)) + _moments(moved, other[cut], len(centres))


def label_centres(df: DataFrame, centres: Sequence[Centre]) -> AreaModel:
    """Label each centre by the mean tier of the rows nearest to it."""
    placed = df.dropna(subset=["latitude", "longitude"])
    assigned = placed.withColumn("cluster", nearest_centre(F.col("latitude"), F.col("longitude"), centres))
    rows = cluster_summary(assigned, len(centres)).orderBy("cluster").collect()
    return AreaModel(tuple(centres), tuple(r.geo_label for r in rows))


def fit_areas(
    df: DataFrame, k: int = DEFAULT_CLUSTERS, restarts: int = CLUSTER_RESTARTS, seed: int = SEED
) -> AreaModel:
    return label_centres(df, fit_centres(df, k, restarts, seed))
