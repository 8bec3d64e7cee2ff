"""Softmax boosting against a plain version, and as a saved model."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lodgetier.operators import boosting


def table(spark, x, label, weight=None, parts=3):
    rows = [(v.tolist(), int(t), float(w)) for v, t, w in zip(x, label, np.ones(len(x)) if weight is None else weight)]
    df = spark.createDataFrame(rows, "x array<double>, label int, weight double").repartition(parts)
    return df.select(array_to_vector("x").alias("features"), "label", "weight")


def plain_rounds(x, label, weight, cuts, classes, rounds, depth):
    """Scores after some rounds on all rows and features, node by node, trying every cut."""
    scores = np.zeros((len(x), classes))
    for _ in range(rounds):
        p = boosting.shares(scores)
        gained = np.zeros_like(scores)
        for k in range(classes):
            g, h = weight * (p[:, k] - (label == k)), weight * np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)

            def grow(rows, level):
                if level < depth:
                    best, chosen = 1e-9, None
                    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    for f in range(x.shape[1]):
                        for cut in cuts[f]:
                            left = rows[x[rows, f] <= cut]
                            right = rows[x[rows, f] > cut]
                            if h[left].sum() < 1 or h[right].sum() < 1:
                                continue
                            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, right)) - whole
                            if gain > best + 1e-9:
                                best, chosen = gain, (left, right)
                    if chosen:
                        for side in chosen:
                            grow(side, level + 1)
                        return
                gained[rows, k] = -boosting.STEP * g[rows].sum() / (h[rows].sum() + 1)

            grow(np.arange(len(x)), 0)
        scores += gained
    return scores


def test_like_a_plain_version_that_tries_every_cut(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 3)).round(2)
    label = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int) + (x[:, 2] > 0.7)
    weight = rng.uniform(0.5, 3, 160)
    rows = table(spark, x, label, weight)
    model = boosting.fit_softmax(rows, classes=3, rounds=10, depth=3, bins=12, row_share=1.0, feature_share=1.0)[0]
    cuts = boosting.cut_points(rows, 3, 12)
    expected = boosting.shares(plain_rounds(x, label, weight, cuts, 3, 10, 3))
    found = model.transform(rows).select(vector_to_array("features").alias("x"), vector_to_array("probability").alias("p")).collect()
    by_row = {tuple(v.tolist()): p for v, p in zip(x, expected)}
    for r in found:
        assert r.p == pytest.approx(by_row[tuple(r.x)].tolist(), abs=1e-6) and sum(r.p) == pytest.approx(1)


def test_models_fitted_together_are_those_fitted_alone(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    label = rng.integers(0, 4, 300)
    rows = table(spark, x, label)
    specs = [boosting.Spec((0, 1, 2, 3)), boosting.Spec((1, 3))]
    together = boosting.fit_softmax(rows, specs, rounds=9, depth=2)
    second = boosting.fit_softmax(rows, [specs[0], specs[1]], rounds=9, depth=2)
    for a, b in zip(together, second):  # reruns agree
        assert a.getOrDefault(a.trees) == b.getOrDefault(b.trees)
    used = set(np.unique(together[1].fitted().feature[np.isfinite(together[1].fitted().cut) & (together[1].fitted().cut < 1e300)]).tolist())
    assert used <= {1, 3}


def test_learns_what_no_single_cut_tells_and_is_saved(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, size=(600, 2))
    label = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int) * 2
    rows = table(spark, x, label)
    model = boosting.fit_softmax(rows, rounds=12, depth=3)[0]
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    found = loaded.transform(rows).select("label", vector_to_array("probability").alias("p")).collect()
    assert np.mean([int(np.argmax(r.p)) == r.label for r in found]) > 0.95
    assert all(len(r.p) == 4 and sum(r.p) == pytest.approx(1) for r in found)


def test_rows_of_one_class_and_flat_features(spark):
    rows = table(spark, np.ones((20, 2)), np.zeros(20))
    model = boosting.fit_softmax(rows, rounds=2)[0]
    p = model.transform(rows).select(vector_to_array("probability").alias("p")).first().p
    assert p[0] == max(p) and sum(p) == pytest.approx(1)
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit_softmax(rows.where(F.lit(False)))


def test_tasks_of_a_pass_do_not_grow_with_the_rows(spark, monkeypatch):
    """Every task sends sums of all nodes, so what is shuffled must not grow with the rows."""
    monkeypatch.setattr(boosting, "TASK_ROWS", 10)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 2))
    parts = []
    once = boosting.Boosting.fit
    monkeypatch.setattr(boosting.Boosting, "fit", lambda self: parts.append(len(self.table.inputFiles())) or once(self))
    boosting.fit_softmax(table(spark, x, (x[:, 0] > 0).astype(int)), rounds=1, depth=1)
    assert parts[0] <= spark.sparkContext.defaultParallelism


def test_one_child_of_two_is_counted_and_tasks_get_blocks(spark, monkeypatch):
    """The other child is its parent's sums less the counted one; trees are those of counting both, and of plain rows."""
    rng = np.random.default_rng(8)
    kind = rng.integers(0, 4, 700)
    x = np.column_stack([rng.normal(size=(700, 3)).round(2), *(kind == k for k in range(3))]).astype(float)
    label = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (kind == 1)
    rows = table(spark, x, label)
    counted, found = [], []
    once = boosting.Boosting._splits

    def splits(self, turn, level, columns, nodes, *more):
        counted.append((level, len(nodes), self.table.count()))
        return once(self, turn, level, columns, nodes, *more)

    monkeypatch.setattr(boosting.Boosting, "_splits", splits)
    for kept in (boosting.KEPT, 0):
        monkeypatch.setattr(boosting, "KEPT", kept)
        found.append(boosting.fit_softmax(rows, rounds=6, depth=4, bins=32)[0].fitted())
    half = len(counted) // 2
    assert sum(n for _, n, _ in counted[:half]) < 0.6 * sum(n for _, n, _ in counted[half:])
    assert all(blocks < 30 for *_, blocks in counted)
    monkeypatch.setattr(boosting, "blocked", lambda df: df)
    found.append(boosting.fit_softmax(rows, rounds=2, depth=4, bins=32)[0].fitted())
    assert (found[0].feature == found[1].feature).all() and (found[0].cut == found[1].cut).all() and np.allclose(found[0].value, found[1].value)
    assert (found[2].feature == found[0].feature[:2]).all() and np.allclose(found[2].value, found[0].value[:2])
