"""Random forests grown level by level, all trees in the same passes.

Rows are binned once: a byte per feature, with label, weight and a hash that says how often a tree draws the row
(Poisson, as bagging with replacement does). A pass brings, for every open node of every tree, the weights by
feature, bin and class; they are added up by node in a shuffle, where the best split by Gini is chosen among a
random share of the features, and the driver gets one row per node. A task holds `HELD` bytes of sums at most, so a
level of very many nodes or bins takes several passes over groups of trees. Features of two values of which a row has
the upper one at most once, as those of a category, are counted together. Forests on other features of the same rows,
or with other weights of the classes, grow in the same passes and share the counts of nodes that hold the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetier.constants import SEED
from lodgetier.operators.boosting import BLOCKS, TASK_ROWS, Counted, _bundles, _chunks, _number, binned, blocked, code_of, cut_points, units_of
from lodgetier.runtime import materialise, ship

#: Bytes of sums that a task holds, and rows that it works on at a time.
HELD = 128 << 20
CHUNK = 1 << 20

#: Bytes that those rows take at most as bins and as counted numbers, and nodes whose sums are sent together.
CHUNK_BYTES = 192 << 20
SENT = 256

#: Gains closer than this are equal; the first split of equals is taken.
EQUAL = 1e-9

#: Share of a node's weight that is no more than rounding.
NOTHING = 1e-12


def _draws(mark: np.ndarray, tree: int, seed: int, table: np.ndarray) -> np.ndarray:
    """How often a tree draws each row, from 16 bits of a hash of row and tree."""
    mixed = mark ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed & (1 << 64) - 1)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed >>= np.uint64(48)
    return table.take(mixed.view(np.int64))


def _poisson(rate: float) -> np.ndarray:
    """Numbers drawn for each of 2 ** 16 equally likely hashes."""
    at, upto, k, p = (np.arange(1 << 16) + 0.5) / (1 << 16), 0.0, 0, np.exp(-rate)
    out = np.zeros(1 << 16, dtype=np.uint8)
    while upto + p < at[-1]:
        upto += p
        k += 1
        out[at > upto] = k
        p *= rate / k
    return out


@dataclass(frozen=True)
class Variant:
    """One of several forests grown on the same draws: the places of its features, and a factor for each class."""

    columns: tuple[int, ...]
    factors: tuple[float, ...]


class Forest:
    """Grows trees on binned rows, of several variants at a time.

    Tree t of every variant draws the same rows, so nodes of variants that were reached by the same splits hold the
    same rows; they are one distinct node, counted once. Tree t of variant v has the number v * trees + t.
    """

    def __init__(
        self, table: DataFrame, bins: list[int], classes: int, trees: int, depth: int, row_share: float, feature_share: float, seed: int,
        bundles: list[list[int]] | None = None, variants: Sequence[Variant] | None = None, weight: str | None = "weight",
    ):
        self.table, self.classes, self.depth, self.seed, self.trees = table, classes, depth, seed, trees
        self.bins, self.rate, self.share, self.weight = bins, row_share, feature_share, weight
        self.variants = list(variants or [Variant(tuple(range(len(bins))), (1.0,) * classes)])
        self.units, self.widths = units_of(bins, bundles)
        self.unit = {f: u for u, unit in enumerate(self.units) for f in unit}
        inner, leaves = (1 << depth) - 1, 1 << depth
        self.feature = np.zeros((trees * len(self.variants), inner), dtype=np.int32)
        self.cut = np.full(self.feature.shape, 255, dtype=np.int32)  # no bin is above: unsplit nodes lead to the left
        self.value = np.zeros((len(self.feature), leaves, classes))
        # Distinct nodes: their number by tree and node, and by the split that leads to them; above, the reverse of that.
        self.number = {(tree, 0): tree % trees for tree in range(len(self.feature))}
        self.below: dict[tuple[int, int, int, bool], int] = {}
        self.above: dict[int, tuple[int, int, int, bool]] = {}

    def fit(self) -> None:
        open_nodes = {(tree, 0) for tree in range(len(self.feature))}
        for level in range(self.depth):
            by_tree: dict[int, list[int]] = {}
            for tree, node in sorted(open_nodes):
                by_tree.setdefault(tree, []).append(node)
            open_nodes = set()
            for group in self._groups(by_tree):
                for r in self._splits(level, group).itertuples(index=False):
                    open_nodes |= self._split(r)

    def _groups(self, by_tree: dict[int, list[int]]) -> Iterator[dict[int, list[int]]]:
        """Trees whose sums a task can hold; those that draw the same rows stay together."""
        group: dict[int, list[int]] = {}
        held = 0
        for drawn in range(self.trees):
            same = {tree: by_tree[tree] for tree in range(drawn, len(self.feature), self.trees) if tree in by_tree}
            size = 8 * self.classes * sum(self.widths[u] for units in self._wanted(same)[1].values() for u in units)
            if group and held + size > HELD:
                yield group
                group, held = {}, 0
            group |= same
            held += size
        if group:
            yield group

    def _looked_at(self, tree: int, node: int) -> list[int]:
        """The features that a node's split is chosen from."""
        columns = self.variants[tree // self.trees].columns
        chosen = max(1, int(np.ceil(self.share * len(columns))))
        drawn = np.random.default_rng([self.seed, tree % self.trees, node]).choice(len(columns), chosen, replace=False)
        return [columns[i] for i in np.sort(drawn).tolist()]

    def _wanted(self, group: dict[int, list[int]]) -> tuple[dict[int, list[tuple[int, int, list[int]]]], dict[int, list[int]]]:
        """By distinct node: (tree, node, features looked at) of those that it stands for, and the units to count."""
        users: dict[int, list[tuple[int, int, list[int]]]] = {}
        for tree, nodes in group.items():
            for node in nodes:
                looked_at = [f for f in self._looked_at(tree, node) if f in self.unit]
                users.setdefault(self.number[tree, node], []).append((tree, node, looked_at))
        # A node that looks at constants only still needs its weights, which any unit tells.
        return users, {number: sorted({self.unit[f] for *_, some in all_of for f in some}) or [0] for number, all_of in users.items()}

    def _ways(self, numbers: Iterable[int]) -> dict[int, list[tuple[int, int, int, int]]]:
        """The splits that lead from the roots to distinct nodes: (feature, cut, left, right) by node, -1 for sides in no need."""
        ways: dict[int, dict[tuple[int, int], list[int]]] = {}
        for number in numbers:
            while number in self.above:
                parent, feature, cut, upper = self.above[number]
                sides = ways.setdefault(parent, {}).setdefault((feature, cut), [-1, -1])
                met, sides[upper], number = sides[upper] >= 0, number, parent
                if met:
                    break
        return {parent: [(*split, *sides) for split, sides in found.items()] for parent, found in ways.items()}

    def _split(self, r) -> set[tuple[int, int]]:
        """Takes a node's split or makes it a leaf; the children that are open."""
        tree, node = r.name >> 32, r.name & 0xFFFFFFFF
        whole, left = np.array(r.whole), np.array(r.left)
        number = self.number.pop((tree, node))
        if r.feature < 0:
            self._leaf(tree, node, whole)
            return set()
        self.feature[tree, node], self.cut[tree, node] = r.feature, r.cut
        found = set()
        for upper, child, weights in ((False, 2 * node + 1, left), (True, 2 * node + 2, whole - left)):
            self._leaf(tree, child, weights)
            if child < self.feature.shape[1] and (weights > EQUAL * weights.sum()).sum() > 1:
                found.add((tree, child))
                way = number, int(r.feature), int(r.cut), upper
                self.number[tree, child] = self.below.setdefault(way, self.trees + len(self.below))
                self.above[self.number[tree, child]] = way
        return found

    def _leaf(self, tree: int, node: int, weights: np.ndarray) -> None:
        """Gives a node's shares to the leaf that unsplit nodes lead to, which is its leftmost one."""
        while node < self.feature.shape[1]:
            node = 2 * node + 1
        weights = np.maximum(weights, 0)
        self.value[tree, node - self.feature.shape[1]] = weights / max(weights.sum(), 1e-300)

    def _splits(self, level: int, group: dict[int, list[int]]) -> pd.DataFrame:
        """(name, feature, cut, whole, left) of the nodes, feature -1 where no split gains."""
        classes, seed, trees, units, widths, weight = self.classes, self.seed, self.trees, self.units, self.widths, self.weight
        users, wanted = self._wanted(group)
        ways, roots = self._ways(users), sorted({tree % trees for tree in group})
        factors = [np.array(v.factors)[:, None] for v in self.variants]
        used, table = sorted({u for some in wanted.values() for u in some}), _poisson(self.rate)
        narrow = np.int16 if classes * max(widths) < 1 << 15 else np.int32
        kind = np.int32 if weight is None else np.float32  # numbers of draws are sent as they are
        most = max(1, min(CHUNK, CHUNK_BYTES // (4 * len(self.bins))))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for chunk in _chunks(batches, most):
                turned = np.ascontiguousarray(chunk["bins"].T)
                label = chunk["label"].astype(narrow)
                joint = {}
                for u in used:
                    joint[u] = label * narrow(widths[u]) + code_of(units[u], turned)
                for root in roots:
                    drawn = _draws(chunk["mark"], root, seed, table)
                    times = drawn.astype(float) if weight is None else drawn * chunk["weight"]
                    left = [(root, np.flatnonzero(drawn))]
                    while left:
                        number, rows = left.pop()
                        if number in wanted and len(rows):
                            by = times.take(rows)
                            counted = [np.bincount(joint[u].take(rows), by, classes * widths[u]).reshape(classes, -1) for u in wanted[number]]
                            total = np.concatenate(counted, axis=1)
                            sums[number] = sums[number] + total if number in sums else total
                        for feature, cut, low, high in ways.get(number, ()):
                            above = turned[feature].take(rows) > cut
                            if low >= 0:
                                left.append((low, rows.take(np.flatnonzero(~above))))
                            if high >= 0:
                                left.append((high, rows.take(np.flatnonzero(above))))
            while sums:
                some = [sums.popitem() for _ in range(min(SENT, len(sums)))]
                data = pa.array([total.astype(kind).tobytes() for _, total in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([number for number, _ in some], pa.int64()), data], ["name", "sums"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for name, data in zip(batch.column("name").to_pylist(), batch.column("sums")):
                    some = np.frombuffer(data.as_buffer(), kind).astype(float)
                    if name in totals:
                        totals[name] += some
                    else:
                        totals[name] = some
            rows = []
            for name, total in totals.items():
                counted = Counted(total.reshape(classes, -1), [units[u] for u in wanted[name]], [widths[u] for u in wanted[name]])
                for tree, node, looked_at in users[name]:
                    rows.append((tree << 32 | node, *_best_split(counted, looked_at, factors[tree // trees])))
            yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(_SPLIT.names)}, schema=_SPLIT)

        columns = [*_number(self.table), "label", *([] if weight is None else [F.col(weight).alias("weight")]), "mark", "bins"]
        parts = self.table.select(*columns).mapInArrow(partial, "name long, sums binary")
        found = parts.repartition("name").mapInArrow(best, "name long, feature int, cut int, whole array<double>, left array<double>")
        return found.toPandas()


_SPLIT = pa.schema(
    [("name", pa.int64()), ("feature", pa.int32()), ("cut", pa.int32()), ("whole", pa.list_(pa.float64())), ("left", pa.list_(pa.float64()))]
)


def _best_split(counted: Counted, features: list[int], factors: np.ndarray) -> tuple[int, int, list[float], list[float]]:
    """The split with the most Gini gain among the features, for classes times factors; the first of equals."""
    left, whole = counted.left * factors, counted.whole * factors[:, 0]
    right = whole[:, None] - left
    n, n_left, n_right = whole.sum(), left.sum(axis=0), right.sum(axis=0)
    inside = (n_left > NOTHING * n) & (n_right > NOTHING * n)
    pure = (left**2).sum(axis=0) / np.where(inside, n_left, 1) + (right**2).sum(axis=0) / np.where(inside, n_right, 1)
    gains = np.where(inside, (pure - (whole**2).sum() / max(n, 1e-300)) / max(n, 1e-300), -1.0)
    best, found = EQUAL, (-1, 0, [])
    for f in features:
        first, last = counted.places[f]
        gain = gains[first:last]
        if len(gain) and (most := gain.max()) > best:
            at = int((gain >= most - EQUAL).argmax())
            if gain[at] > best + EQUAL:
                best, found = gain[at], (f, at, left[:, first + at].tolist())
    return found[0], found[1], whole.tolist(), found[2]


class ForestModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Class probabilities of a forest, as a stage that is saved like any other."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features", typeConverter=TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "features, cuts and shares of all trees", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", trees: str = "{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def of(forest: Forest, cuts: list[np.ndarray], features: str, variant: int = 0) -> ForestModel:
        """With cuts between bins turned into values: a bin above `b` is a value above the b-th cut."""
        own = slice(variant * forest.trees, (variant + 1) * forest.trees)
        feature, cut = forest.feature[own], forest.cut[own]
        bound = np.full(cut.shape, 1e308)
        for place in np.argwhere(cut < 255):
            bound[tuple(place)] = cuts[feature[tuple(place)]][cut[tuple(place)]]
        data = {"feature": feature.tolist(), "cut": bound.tolist(), "value": forest.value[own].tolist()}
        return ForestModel(featuresCol=features, trees=json.dumps(data))

    def fitted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = json.loads(self.getOrDefault(self.trees))
        return np.array(data["feature"], dtype=np.int64), np.array(data["cut"]), np.array(data["value"])

    @property
    def getNumTrees(self) -> int:
        return len(self.fitted()[0])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        feature, cut, value = self.fitted()
        depth = value.shape[1].bit_length() - 1

        @F.pandas_udf("array<double>")
        def probability(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.stack(rows.to_numpy())
            flat, each = x.ravel(), np.arange(len(x)) * x.shape[1]
            total = np.zeros((len(x), value.shape[2]))
            for t in range(len(feature)):
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(depth):
                    at = 2 * at + 1 + (flat.take(each + feature[t].take(at)) > cut[t].take(at))
                total += value[t][at - feature.shape[1]]
            return pd.Series(list(total / total.sum(axis=1, keepdims=True)), dtype=object)

        x = vector_to_array(F.col(self.getOrDefault(self.featuresCol)))
        return dataset.withColumn("probability", array_to_vector(probability(x)))


def _without_constants(rows: DataFrame, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """The cuts, none for features that have one value only."""
    single = [i for i, c in enumerate(cuts) if len(c) == 1]
    if not single:
        return cuts
    values = rows.select(vector_to_array("features").alias("x"))
    highest = values.agg(*(F.max(F.col("x")[i]).alias(f"m{i}") for i in single)).first()
    return [c if i not in single or highest[f"m{i}"] > c[0] else c[:0] for i, c in enumerate(cuts)]


@dataclass(frozen=True)
class Planned:
    """A forest to grow: its variant, the weights of its rows unless they follow from the class, and its settings."""

    variant: Variant
    weight: str | None
    settings: tuple
    features: str


@dataclass(frozen=True)
class BinnedRows:
    """Rows as bytes, written once for any number of forests on some or all of their features."""

    table: DataFrame
    cuts: list[np.ndarray]
    bundles: list[list[int]]
    factors: dict[str, dict[int, float]]  # by class, for weights that all rows of a class share

    def grow(
        self, classes: int, trees: int, depth: int, row_share: float = 0.8, feature_share: float = 0.8, seed: int = SEED,
        features: str = "features", columns: list[int] | None = None, weight: str = "weight", later: bool = False,
    ) -> ForestModel | Planned:
        """A forest on the features at `columns`; its model reads them from the whole vector.

        With `later` it is only planned, to be grown with others by `grow_together`.
        """
        factors = tuple(self.factors.get(weight, {}).get(c, 1.0) for c in range(classes))
        variant = Variant(tuple(range(len(self.cuts)) if columns is None else columns), factors)
        settings = classes, trees, depth, row_share, feature_share, seed
        planned = Planned(variant, None if weight in self.factors else weight, settings, features)
        return planned if later else self.grow_together([planned])[0]

    def grow_together(self, plans: Sequence[Planned]) -> list[ForestModel]:
        """The planned forests, those of the same settings and weights in the same passes."""
        widths, alike = [len(c) + 1 for c in self.cuts], {}
        for i, plan in enumerate(plans):
            alike.setdefault((plan.settings, plan.weight), []).append(i)
        models = {}
        for (settings, weight), some in alike.items():
            forest = Forest(self.table, widths, *settings, self.bundles, [plans[i].variant for i in some], weight)
            forest.fit()
            models |= {i: ForestModel.of(forest, self.cuts, plans[i].features, at) for at, i in enumerate(some)}
        return [models[i] for i in range(len(plans))]


def _factors(rows: DataFrame, weights: Sequence[str]) -> dict[str, dict[int, float]]:
    """By class, the weights that all rows of a class share."""
    ends = [end(w).alias(f"{name}{i}") for i, w in enumerate(weights) for name, end in (("low", F.min), ("high", F.max))]
    found = rows.groupBy("label").agg(F.count(F.lit(1)), *ends).collect()  # a row per class
    shared = [(i, w) for i, w in enumerate(weights) if all(r[f"low{i}"] == r[f"high{i}"] for r in found)]
    return {w: {r.label: r[f"low{i}"] for r in found} for i, w in shared}


def bin_rows(rows: DataFrame, bins: int, weights: Sequence[str] = ("weight",)) -> BinnedRows:
    """Rows (features, label, weights) ready for forests."""
    if not 2 <= bins <= 255:
        raise ValueError("a bin is a byte")
    some = rows.select("features").first()
    if some is None:
        raise ValueError("no rows to fit on")
    cuts = _without_constants(rows, cut_points(rows, len(some.features), bins))
    # Every task sends its sums of all nodes, so there are no more tasks than can run at a time. Rows are dealt to them
    # as bins, a byte a feature, and not as vectors of doubles.
    tasks = min(-(-rows.count() // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    table = materialise(blocked(binned(rows, cuts, weights).repartition(tasks)), "binned", **BLOCKS)
    return BinnedRows(table, cuts, _bundles(table, [len(c) + 1 for c in cuts]), _factors(rows, weights))


def fit_forest(
    rows: DataFrame, classes: int, trees: int, depth: int, bins: int, row_share: float = 0.8, feature_share: float = 0.8,
    seed: int = SEED, features: str = "features",
) -> ForestModel:
    """A forest on rows (features, label, weight); labels are whole numbers from 0 to classes - 1.

    A row is drawn `row_share` times on average by each tree; a node looks at a random share of the features.
    """
    return bin_rows(rows, bins).grow(classes, trees, depth, row_share, feature_share, seed, features)
