"""Gradient boosting of trees under one softmax objective for all tiers, many models at a time.

Rows are binned once: a byte per feature, with the label, weights and a hash that picks the rows of a round. A
pass over them brings, for every open node of every model's trees, sums of gradients and second derivatives by
feature and bin; they are added up by node in a shuffle, where the best split is chosen, and the driver gets
one row per node. A level of all trees of a round costs one pass, whatever the number of models and tiers. Of two
children only the one of less weight is counted; the other is their parent's sums, as far as the driver may keep
those (`KEPT`), less the first one's.

Scores of the rows so far are kept in a written table that is renewed every `SAVED` rounds; a pass applies the
trees since then to what it reads, so lost executors cost no more than that.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
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
from lodgetier.runtime import materialise, ship

ROUNDS = 400
DEPTH = 6
STEP = 0.05
ROW_SHARE = 0.8
FEATURE_SHARE = 0.8
BINS = 128

#: Added to the second derivatives of a leaf; least sum of them in a child.
RIDGE = 1.0
LEAST_CHILD = 1.0

#: Rounds between two written tables of scores, and rows from which on a task of a pass is worth it.
SAVED = 4
TASK_ROWS = 32_768

#: Bytes of sums of a level's nodes that the driver keeps; their size depends on features and bins only.
KEPT = 32 << 20

#: Rows whose gradients are worked out at a time, and rows of a block, with the writer's options for blocks.
GRADIENTS = 1 << 16
BLOCK = 1 << 16
BLOCKS = {"parquet.block.size": str(32 << 20), "parquet.enable.dictionary": "false"}

#: Kinds of packed numbers; weights are doubles.
_PACKED = {"label": np.int32, "mark": np.uint64, "bins": np.uint8, "scores": np.float32}

#: Features of few bins that are looked at for being counted together.
PAIRED = 256


@dataclass(frozen=True)
class Spec:
    """A model to fit: the places of its features, and the column with its weights."""

    features: tuple[int, ...]
    weight: str = "weight"


@dataclass
class Trees:
    """Complete trees, by round and class: feature and cut of inner nodes in heap order, values of leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(rounds: int, classes: int, depth: int) -> Trees:
        inner, leaves = (1 << depth) - 1, 1 << depth
        return Trees(
            np.zeros((rounds, classes, inner), dtype=np.int32), np.full((rounds, classes, inner), np.inf), np.zeros((rounds, classes, leaves))
        )

    @property
    def depth(self) -> int:
        return self.value.shape[2].bit_length() - 1

    def node(self, x: np.ndarray, turn: int, k: int, levels: int) -> np.ndarray:
        """The node, in heap order, that each row reaches after some levels of a tree."""
        feature, cut = self.feature[turn, k].astype(np.int64), self.cut[turn, k]
        if not levels:
            return np.zeros(len(x), dtype=np.int64)
        at = 1 + (x[:, feature[0]] > cut[0]).astype(np.int64)
        flat, rows = x.ravel(), np.arange(len(x)) * x.shape[1]
        for _ in range(levels - 1):
            at = 2 * at + 1 + (flat.take(rows + feature.take(at)) > cut.take(at))
        return at

    def parted(
        self, turned: np.ndarray, turn: int, k: int, levels: int, rows: np.ndarray, wanted: set[int] | None = None
    ) -> Iterator[tuple[int, np.ndarray]]:
        """(node, rows) after some levels of a tree, from bins by feature; with `wanted`, of those nodes only."""
        feature, cut = self.feature[turn, k].tolist(), self.cut[turn, k].tolist()
        needed = None if wanted is None else {(node + 1 >> up) - 1 for node in wanted for up in range(levels + 1)}
        left = [(0, rows, levels)]
        while left:
            node, rows, more = left.pop()
            if not more:
                yield node, rows
                continue
            low, high = 2 * node + 1, 2 * node + 2
            if cut[node] == np.inf:  # unsplit nodes lead to the left
                left.append((low, rows, more - 1))
                continue
            above = turned[feature[node]].take(rows) > cut[node]
            for child, side in ((low, ~above), (high, above)):
                if needed is None or child in needed:
                    left.append((child, rows.take(np.flatnonzero(side)), more - 1))

    def added(self, turned: np.ndarray, last: int) -> np.ndarray:
        """Sums of the leaves that each row reaches in the first rounds, by class, from bins by feature."""
        depth, classes, everything = self.depth, self.value.shape[1], np.arange(turned.shape[1])
        out = np.zeros((classes, turned.shape[1]))
        for turn in range(last):
            for k in range(classes):
                for node, rows in self.parted(turned, turn, k, depth, everything):
                    out[k, rows] += self.value[turn, k, node - ((1 << depth) - 1)]
        return out.T

    def scores(self, x: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Sums of the leaves that each row reaches, by class."""
        depth, classes = self.depth, self.value.shape[1]
        out = np.zeros((len(x), classes))
        for turn in range(first, len(self.value) if last is None else last):
            for k in range(classes):
                out[:, k] += self.value[turn, k][self.node(x, turn, k, depth) - ((1 << depth) - 1)]
        return out


def shares(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def cut_points(rows: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Up to bins - 1 increasing cuts per feature, from one aggregation; a value goes right of cuts below it."""
    places = [i / bins for i in range(1, bins)]
    values = rows.select(vector_to_array("features").alias("x"))
    found = values.agg(*(F.percentile_approx(F.col("x")[i], places, 20 * bins).alias(f"q{i}") for i in range(width))).first()
    return [np.unique(np.array(found[f"q{i}"] or [], dtype=float)) for i in range(width)]


def binned(rows: DataFrame, cuts: list[np.ndarray], weights: Sequence[str]) -> DataFrame:
    """(label, weights..., mark, bins, scores): a byte per feature; no scores yet."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), len(cuts))
            codes = np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.uint8)
            kept = [batch.column(c) for c in ("label", *weights, "mark")]
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, packed, pa.array([b""] * len(x), pa.binary())], ["label", *weights, "mark", "bins", "scores"])

    x = vector_to_array("features")
    mark = F.xxhash64(x, "label", F.monotonically_increasing_id())
    narrow = rows.select("label", *weights, mark.alias("mark"), x.alias("x"))
    return narrow.mapInArrow(run, _schema(weights))


def _schema(weights: Sequence[str]) -> str:
    return "label int, " + "".join(f"{w} double, " for w in weights) + "mark long, bins binary, scores binary"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def packed_bytes(column: pa.Array, kind, n: int, *shape: int) -> np.ndarray:
    """The numbers of equally long binary values, read from the column's buffer as it is."""
    kind, (ends, data) = np.dtype(kind), column.buffers()[1:]
    empty = np.zeros((n, *(max(s, 0) for s in shape)), dtype=kind)
    if not n or data is None:
        return empty
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return raw.view(kind).reshape(n, *shape) if len(raw) else empty


def _sampled(mark: np.ndarray, turn: int, share: float) -> np.ndarray:
    mixed = (mark.view(np.uint64) ^ np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(11)).astype(float) < share * (1 << 53)


def blocked(table: DataFrame) -> DataFrame:
    """Binned rows in blocks: a row of about `BLOCK` rows' numbers by column, which tasks of Python get as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, BLOCK):
            yield _block(chunk)

    return table.mapInArrow(run, "n int, " + ", ".join(f"{c} binary" for c in table.columns))


def _block(chunk: dict[str, np.ndarray]) -> pa.RecordBatch:
    data = [pa.array([np.ascontiguousarray(some).tobytes()], pa.binary()) for some in chunk.values()]
    return pa.RecordBatch.from_arrays([pa.array([len(chunk["bins"])], pa.int32()), *data], ["n", *chunk])


def _unpacked(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """Numbers by column of a batch of binned rows or of each of its blocks."""
    names = [c for c in batch.schema.names if c != "n"]
    kinds = {c: np.dtype(_PACKED.get(c, np.float64)) for c in names}
    if "n" not in batch.schema.names:
        n = batch.num_rows
        plain = {c: batch.column(c).to_numpy().view(kinds[c]) for c in names if c not in ("bins", "scores")}
        yield {c: plain[c] if c in plain else packed_bytes(batch.column(c), kinds[c], n, -1) for c in names}
        return
    for i, n in enumerate(batch.column("n").to_pylist()):
        flat = {c: np.frombuffer(batch.column(c)[i].as_buffer(), kinds[c]) for c in names}
        yield {c: some.reshape(n, len(some) // n) if c in ("bins", "scores") else some for c, some in flat.items()}


def _chunks(batches: Iterator[pa.RecordBatch], most: int = GRADIENTS) -> Iterator[dict[str, np.ndarray]]:
    """Numbers by column of `most` rows or somewhat more at a time."""
    held: list[dict[str, np.ndarray]] = []
    rows = 0

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([some[c] for some in held]) for c in held[0]}

    for batch in batches:
        for some in _unpacked(batch) if batch.num_rows else ():
            held.append(some)
            rows += len(next(iter(some.values())))
            if rows >= most:
                yield whole()
                held, rows = [], 0
    if rows:
        yield whole()


def _bundles(table: DataFrame, bins: list[int]) -> list[list[int]]:
    """Groups of features that use their two lowest bins only, of which no row is in the upper one of two."""
    two = [f for f, width in enumerate(bins) if 2 <= width <= 3][:PAIRED]  # the last of three may be above the highest value
    if len(two) < 2:
        return []

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((len(two), len(two)), dtype=bool)
        for chunk in _chunks(batches):
            codes = chunk["bins"][:, two]
            upper, more = (codes > 0).astype(np.float32), (codes > 1).any(axis=0)
            met |= (upper.T @ upper > 0) | more[:, None] | more[None, :]
        yield pa.RecordBatch.from_arrays([pa.array([met.tobytes()], pa.binary())], ["met"])

    parts = table.select(*_number(table), "bins").mapInArrow(together, "met binary").distinct().collect()  # some KB of a task
    met = np.any([np.frombuffer(bytes(r.met), dtype=bool).reshape(len(two), len(two)) for r in parts], axis=0)
    groups: list[list[int]] = []
    for i in range(len(two)):
        for group in groups:
            if len(group) + 1 < max(bins) and not met[i, group].any():
                group.append(i)
                break
        else:
            groups.append([i])
    return [[two[i] for i in group] for group in groups if len(group) > 1]


def _number(table: DataFrame) -> list[str]:
    """The column that tells blocks from rows."""
    return [c for c in table.columns if c == "n"]


def units_of(bins: list[int], bundles: list[list[int]] | None) -> tuple[list[list[int]], list[int]]:
    """Features that are counted together or alone, and the bins of each unit; the same value everywhere tells nothing."""
    grouped = {f for b in bundles or [] for f in b}
    units = [*(bundles or []), *([f] for f, width in enumerate(bins) if width > 1 and f not in grouped)] or [[0]]
    return units, [bins[unit[0]] if len(unit) == 1 else len(unit) + 1 for unit in units]


def code_of(unit: list[int], turned: np.ndarray) -> np.ndarray:
    """The bin of each row in a unit, from bins by feature; of features counted together the one above its lowest bin."""
    return turned[unit[0]] if len(unit) == 1 else sum(turned[f] * np.uint8(i) for i, f in enumerate(unit, 1))


class Counted:
    """Sums of a distinct node (classes, bins of its units in a row), and what splitting at each place gives."""

    def __init__(self, sums: np.ndarray, units: list[list[int]], widths: list[int]):
        ends = np.cumsum([0, *widths])
        upto = np.cumsum(sums, axis=1)
        before = np.concatenate([np.zeros((len(sums), 1)), upto], axis=1)[:, ends[:-1]]
        self.whole = sums[:, : ends[1]].sum(axis=1)
        # On the left: bins up to a place, or of features counted together all but those in the upper bin of one.
        self.left = upto - np.repeat(before, widths, axis=1)
        self.places: dict[int, tuple[int, int]] = {}
        for unit, first, last in zip(units, ends[:-1].tolist(), ends[1:].tolist()):
            if len(unit) == 1:
                self.places[unit[0]] = first, last - 1
                continue
            self.left[:, first:last] = self.whole[:, None] - sums[:, first:last]
            self.places |= {f: (first + i, first + i + 1) for i, f in enumerate(unit, 1)}


class Boosting:
    """Fits models of `specs` on binned rows, all in the same passes."""

    def __init__(
        self, table: DataFrame, specs: Sequence[Spec], classes: int, rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP,
        row_share: float = ROW_SHARE, feature_share: float = FEATURE_SHARE, seed: int = SEED, bins: Sequence[int] = (),
        bundles: list[list[int]] | None = None,
    ):
        self.units, self.widths = units_of(list(bins), bundles)
        self.unit = {f: u for u, unit in enumerate(self.units) for f in unit}
        self.table, self.specs, self.classes, self.depth, self.step = table, list(specs), classes, depth, step
        self.weights = sorted({s.weight for s in specs})
        self.row_share, self.feature_share, self.seed = row_share, feature_share, seed
        self.trees = [Trees.empty(rounds, classes, depth) for _ in specs]
        self.rounds, self.saved = rounds, 0

    def fit(self) -> list[Trees]:
        """Trees whose cuts are bins: a row goes right if its bin is above."""
        for turn in range(self.rounds):
            if turn - self.saved == SAVED:
                self._save(turn)
            self._grow(turn)
        return self.trees

    def _columns(self, turn: int, model: int, k: int) -> np.ndarray:
        features = np.array(self.specs[model].features)
        n = max(1, round(self.feature_share * len(features)))
        return np.sort(np.random.default_rng([self.seed, turn, model, k]).choice(features, n, replace=False))

    def _grow(self, turn: int) -> None:
        columns = {(m, k): self._columns(turn, m, k) for m in range(len(self.specs)) for k in range(self.classes)}
        # A node to count by the one that is its parent's sums less it, or -1; and sums of parents.
        counted: dict[Node, int] = {(*key, 0): -1 for key in columns}
        kept: dict[Node, bytes] = {}
        for level in range(self.depth):
            if not counted:
                break
            size = sum(16 * sum(self.widths[u] for u in self._counted(columns[name[:2]])) * (1 + (other >= 0)) for name, other in counted.items())
            keep = level + 1 < self.depth and size <= KEPT
            found = self._splits(turn, level, columns, counted, kept, keep)
            counted, kept = {}, {}
            for (m, k, node), (feature, cut, g, h, g_left, h_left, sums) in sorted(found.items()):
                trees = self.trees[m]
                if feature < 0:
                    self._leaf(trees, turn, k, node, g, h)
                    continue
                trees.feature[turn, k, node], trees.cut[turn, k, node] = feature, cut
                low, high = 2 * node + 1, 2 * node + 2
                for child, cg, ch in ((low, g_left, h_left), (high, g - g_left, h - h_left)):
                    self._leaf(trees, turn, k, child, cg, ch)
                if keep:
                    few, many = (low, high) if h_left <= h - h_left else (high, low)
                    counted[m, k, few], kept[m, k, few] = many, bytes(sums)
                else:
                    counted |= {(m, k, low): -1, (m, k, high): -1}

    def _counted(self, columns: np.ndarray) -> list[int]:
        return sorted({self.unit[f] for f in columns.tolist() if f in self.unit}) or [0]

    def _leaf(self, trees: Trees, turn: int, k: int, node: int, g: float, h: float) -> None:
        """Gives a node's value to the leaf that unsplit nodes lead to, which is its leftmost one."""
        while node < (1 << self.depth) - 1:
            node = 2 * node + 1
        trees.value[turn, k, node - ((1 << self.depth) - 1)] = -self.step * g / (h + RIDGE)

    def _splits(
        self, turn: int, level: int, columns: dict[tuple[int, int], np.ndarray], counted: dict[Node, int], kept: dict[Node, bytes], keep: bool
    ) -> dict[Node, tuple]:
        """(model, class, node) to (feature, cut, g, h, g left, h left, sums), feature -1 where no split gains."""
        saved, trees, specs, classes, share = self.saved, self.trees, self.specs, self.classes, self.row_share
        recent = [Trees(t.feature[saved : turn + 1], t.cut[saved : turn + 1], t.value[saved : turn + 1]) for t in trees]
        units, widths, now = self.units, self.widths, turn - saved
        own = {key: self._counted(some) for key, some in columns.items()}
        looked_at = {key: [f for f in some.tolist() if f in self.unit] for key, some in columns.items()}
        used = sorted({u for some in own.values() for u in some})
        keys = list(columns)
        wanted = {key: {node for *some, node in counted if tuple(some) == key} for key in keys}

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[Node, np.ndarray] = {}
            for chunk in _chunks(batches):
                on = np.flatnonzero(_sampled(chunk["mark"], turn, share))
                if not len(on):
                    continue
                turned = np.ascontiguousarray(chunk["bins"].take(on, axis=0).T)
                scores = _scores(chunk, len(specs), classes).take(on, axis=0)
                label, everything = chunk["label"].take(on), np.arange(len(on))
                codes = {u: code_of(units[u], turned) for u in used}
                for m, spec in enumerate(specs):
                    if not any(wanted[m, k] for k in range(classes)):
                        continue
                    p = shares(scores[:, m] + recent[m].added(turned, now))
                    weight = chunk[spec.weight].take(on)
                    for k in range(classes):
                        if not wanted[m, k]:
                            continue
                        g = weight * (p[:, k] - (label == k))
                        h = weight * np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)
                        for node, rows in recent[m].parted(turned, now, k, level, everything, wanted[m, k]):
                            if not len(rows):
                                continue
                            some_g, some_h = g.take(rows), h.take(rows)
                            total = np.empty((2, sum(widths[u] for u in own[m, k])))
                            first = 0
                            for u in own[m, k]:
                                at, last = codes[u].take(rows).astype(np.intp), first + widths[u]
                                total[0, first:last] = np.bincount(at, some_g, widths[u])
                                total[1, first:last] = np.bincount(at, some_h, widths[u])
                                first = last
                            sums[m, k, node] = sums[m, k, node] + total if (m, k, node) in sums else total
            names = [keys.index((m, k)) << 32 | node for m, k, node in sums]
            data = pa.array([total.tobytes() for total in sums.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), data], ["name", "sums"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for name, data in zip(batch.column("name").to_pylist(), batch.column("sums")):
                    some = np.frombuffer(data.as_buffer(), np.float64).reshape(2, -1)
                    totals[name] = totals[name] + some if name in totals else some
            rows = []
            for name, total in totals.items():
                key = keys[name >> 32]
                name_of = *key, name & 0xFFFFFFFF
                both = [(name, total)]
                if counted[name_of] >= 0:
                    whole = np.frombuffer(kept[name_of], np.float64).reshape(2, -1)
                    both.append((name >> 32 << 32 | counted[name_of], whole - total))
                for some, sums in both:
                    laid = Counted(sums, [units[u] for u in own[key]], [widths[u] for u in own[key]])
                    rows.append((some, *_best_split(laid, looked_at[key]), np.ascontiguousarray(sums).tobytes() if keep else b""))
            yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(_SPLIT)}, schema=_SPLIT_SCHEMA)

        parts = self.table.select(*_number(self.table), "label", *self.weights, "mark", "bins", "scores").mapInArrow(partial, "name long, sums binary")
        named = "name long, feature int, cut double, g double, h double, gl double, hl double, sums binary"
        found = parts.repartition("name").mapInArrow(best, named)
        return {(*keys[r.name >> 32], r.name & 0xFFFFFFFF): tuple(r)[1:] for r in found.toPandas().itertuples(index=False)}

    def _save(self, turn: int) -> None:
        """Writes the rows with their scores after the rounds so far."""
        saved, trees, n_specs, classes = self.saved, self.trees, len(self.specs), self.classes
        weights = self.weights
        recent = [Trees(t.feature[saved:turn], t.cut[saved:turn], t.value[saved:turn]) for t in trees]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in _chunks(batches):
                turned = np.ascontiguousarray(chunk["bins"].T)
                scores = _scores(chunk, n_specs, classes).copy()
                for m, some in enumerate(recent):
                    scores[:, m] += some.added(turned, turn - saved)
                yield _block(chunk | {"scores": scores})

        names = ["label", *weights, "mark", "bins", "scores"]
        written = self.table.select(*_number(self.table), *names).mapInArrow(run, "n int, " + ", ".join(f"{c} binary" for c in names))
        self.table = materialise(written, "scores", **BLOCKS)
        self.saved = turn


def _scores(chunk: dict[str, np.ndarray], n_specs: int, classes: int) -> np.ndarray:
    """Scores by row, model and class; none are written before the first rounds."""
    scores = chunk["scores"]
    return scores.reshape(-1, n_specs, classes) if scores.size else np.zeros((len(scores), n_specs, classes), dtype=np.float32)


#: Model, class and node.
Node = tuple[int, int, int]

_SPLIT = ["name", "feature", "cut", "g", "h", "gl", "hl", "sums"]
_KINDS = {"name": pa.int64(), "feature": pa.int32(), "sums": pa.binary()}
_SPLIT_SCHEMA = pa.schema([(c, _KINDS.get(c, pa.float64())) for c in _SPLIT])


def _best_split(counted: Counted, features: list[int]) -> tuple[int, float, float, float, float, float]:
    """The split with the most gain among the features; the first of equals."""
    g, h = counted.whole
    gl, hl = counted.left
    gr, hr = g - gl, h - hl
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g**2 / (h + RIDGE)
    gains[(hl < LEAST_CHILD) | (hr < LEAST_CHILD)] = -np.inf
    best, found = 1e-9, (-1, 0.0, float(g), float(h), 0.0, 0.0)
    for f in features:
        first, last = counted.places[f]
        if first < last and (most := gains[first:last].max()) > best:
            at = first + int(gains[first:last].argmax())
            best, found = most, (f, float(at - first), float(g), float(h), float(gl[at]), float(hl[at]))
    return found


class SoftmaxTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Class probabilities of boosted trees, as a stage that is saved like any other."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features", typeConverter=TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "features, cuts and values of all trees", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", trees: str = "{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def of(trees: Trees, cuts: list[np.ndarray], features: str = "features") -> SoftmaxTreesModel:
        """With cuts between bins turned into values: a bin above `b` is a value above the b-th cut."""
        bound = trees.cut.copy()
        for place in np.argwhere(np.isfinite(bound)):
            own = cuts[trees.feature[tuple(place)]]
            b = int(bound[tuple(place)])
            bound[tuple(place)] = own[b] if b < len(own) else np.inf
        data = {"feature": trees.feature.tolist(), "cut": np.where(np.isfinite(bound), bound, 1e308).tolist(), "value": trees.value.tolist()}
        return SoftmaxTreesModel(featuresCol=features, trees=json.dumps(data))

    def fitted(self) -> Trees:
        data = json.loads(self.getOrDefault(self.trees))
        return Trees(np.array(data["feature"], dtype=np.int32), np.array(data["cut"]), np.array(data["value"]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        trees = self.fitted()

        @F.pandas_udf("array<double>")
        def probability(x: pd.Series) -> pd.Series:
            return pd.Series(list(shares(trees.scores(np.stack(x.to_numpy())))) if len(x) else [], dtype=object)

        x = vector_to_array(F.col(self.getOrDefault(self.featuresCol)))
        return dataset.withColumn("probability", array_to_vector(probability(x)))


def fit_softmax(
    rows: DataFrame, specs: Sequence[Spec] | None = None, classes: int = 4, rounds: int = ROUNDS, bins: int = BINS, features: str = "features", **settings
) -> list[SoftmaxTreesModel]:
    """A model for each spec from rows (label, weight columns, features); by default one, of all features.

    Rows without a label must have been left out; labels are whole numbers from 0 to classes - 1.
    """
    if not 2 <= bins <= 256:
        raise ValueError("a bin is a byte")
    named = rows.withColumnRenamed(features, "features") if features != "features" else rows
    some = named.select("features").first()
    if some is None:
        raise ValueError("no rows to fit on")
    width = len(some.features)
    specs = list(specs or [Spec(tuple(range(width)))])
    cuts = cut_points(named, width, bins)
    weights = sorted({s.weight for s in specs})
    # Every task sends its sums of all nodes, so there are no more tasks than can run at a time.
    tasks = min(-(-named.count() // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    table = materialise(blocked(binned(named, cuts, weights).repartition(tasks)), "binned", **BLOCKS)
    widths = [len(c) + 1 for c in cuts]
    fits = Boosting(table, specs, classes, rounds, bins=widths, bundles=_bundles(table, widths), **settings).fit()
    return [SoftmaxTreesModel.of(trees, cuts, features) for trees in fits]
