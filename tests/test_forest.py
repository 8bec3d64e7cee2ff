"""The forest against a plain version, its passes, and as a saved model."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lodgetier.operators import forest
from lodgetier.operators.boosting import binned, cut_points
from lodgetier.plans import train


def table(spark, x, label, weight=None, parts=3):
    rows = [(v.tolist(), int(t), float(w)) for v, t, w in zip(x, label, np.ones(len(x)) if weight is None else weight)]
    df = spark.createDataFrame(rows, "x array<double>, label int, weight double").repartition(parts)
    return df.select(array_to_vector("x").alias("features"), "label", "weight")


def gini(weight, label, classes):
    share = np.bincount(label, weight, minlength=classes) / max(weight.sum(), 1e-300)
    return 1 - (share**2).sum()


def plain_tree(x, label, weight, cuts, classes, depth):
    """Shares by row of a tree on rows with weights, trying every cut."""
    out = np.zeros((len(x), classes))

    def grow(rows, drawn, level):
        best, chosen = 1e-9, None
        if level < depth and weight[drawn].sum():
            whole, n = gini(weight[drawn], label[drawn], classes), weight[drawn].sum()
            for f in range(x.shape[1]):
                for cut in cuts[f]:
                    sides = drawn[x[drawn, f] <= cut], drawn[x[drawn, f] > cut]
                    if min(len(s) for s in sides) == 0:
                        continue
                    gain = whole - sum(weight[s].sum() / n * gini(weight[s], label[s], classes) for s in sides)
                    if gain > best + 1e-9:
                        best, chosen = gain, (f, cut)
        if chosen is None:
            out[rows] = np.bincount(label[drawn], weight[drawn], minlength=classes) / weight[drawn].sum()
            return
        f, cut = chosen
        for left in (True, False):
            grow(rows[(x[rows, f] <= cut) == left], drawn[(x[drawn, f] <= cut) == left], level + 1)

    everything = np.arange(len(x))
    grow(everything, everything[weight > 0], 0)
    return out


def test_like_a_plain_version_that_tries_every_cut(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)).round(2)
    label = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=300) / 3 > 0).astype(int) + (x[:, 2] > 0.7)
    weight = rng.integers(1, 4, 300).astype(float)
    rows = table(spark, x, label, weight)
    cuts = cut_points(rows, 3, 12)
    packed = forest.materialise(binned(rows, cuts, ["weight"]), "binned")
    grown = forest.Forest(packed, [len(c) + 1 for c in cuts], 3, 4, 3, 0.8, 1.0, 7)
    grown.fit()
    model = forest.ForestModel.of(grown, cuts, "features")
    kept = packed.collect()
    codes = np.array([list(r.bins) for r in kept], dtype=float)
    bins = [np.arange(len(c)) for c in cuts]
    marks = np.array([r.mark for r in kept], dtype=np.int64).view(np.uint64)
    expected = np.zeros((len(kept), 3))
    for tree in range(4):
        drawn = forest._draws(marks, tree, 7, forest._poisson(0.8))
        own = np.array([r.weight for r in kept]) * drawn
        expected += plain_tree(codes, np.array([r.label for r in kept]), own, bins, 3, 3) / 4
    by_bins = {tuple(c): p for c, p in zip(codes.astype(int).tolist(), expected)}
    found = model.transform(rows).select(vector_to_array("features").alias("x"), vector_to_array("probability").alias("p")).collect()
    for r in found:
        at = tuple(int(np.searchsorted(c, v)) for c, v in zip(cuts, r.x))
        assert r.p == pytest.approx(by_bins[at].tolist(), abs=1e-5)


def test_draws_are_poisson_and_differ_by_tree():
    marks = np.random.default_rng(1).integers(0, 1 << 63, 200_000).astype(np.uint64)
    first, second = (forest._draws(marks, t, 42, forest._poisson(0.8)).astype(float) for t in (0, 1))
    assert first.mean() == pytest.approx(0.8, abs=0.01) == second.mean() and first.var() == pytest.approx(0.8, abs=0.02)
    assert abs(np.corrcoef(first, second)[0, 1]) < 0.01


def test_all_trees_share_a_pass_a_level(spark, monkeypatch):
    """A registered model is grown in one pass a level, and in groups of trees where sums would not fit a task."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    rows = table(spark, x, (x[:, 0] > 0) * 2 + (x[:, 1] > 0)).select("features", F.col("label").alias("price_tier"))
    passes = []
    once = forest.Forest._splits
    monkeypatch.setattr(forest.Forest, "_splits", lambda self, level, group: passes.append(level) or once(self, level, group))
    whole = train.fit_classifier(rows, None, balanced=False, trees=30)
    assert len(passes) <= train.DEPTH and whole.stages[-1].getNumTrees == 30
    passes.clear()
    monkeypatch.setattr(forest, "HELD", 1 << 18)
    grouped = train.fit_classifier(rows, None, balanced=False, trees=30)
    assert len(passes) > train.DEPTH
    assert [np.array_equal(a, b) for a, b in zip(whole.stages[-1].fitted(), grouped.stages[-1].fitted())] == [True] * 3


def test_one_class_flat_features_and_saving(spark, tmp_path):
    rows = table(spark, np.ones((20, 2)), np.full(20, 2))
    model = forest.fit_forest(rows, 4, 3, 4, 16)
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert loaded.transform(rows).select(vector_to_array("probability").alias("p")).first().p == [0, 0, 1, 0]
    with pytest.raises(ValueError, match="no rows"):
        forest.fit_forest(rows.where(F.lit(False)), 4, 3, 4, 16)


def test_values_of_a_category_are_counted_together(spark):
    """Exclusive columns share their counts; the forest is the one that counts every column by itself."""
    rng = np.random.default_rng(8)
    kind, flag = rng.integers(0, 5, 600), rng.integers(0, 2, 600)
    x = np.column_stack([rng.normal(size=600).round(2), *(kind == k for k in range(4)), flag]).astype(float)
    label = (x[:, 0] > 0).astype(int) + (kind == 2) + 2 * ((kind == 3) & (flag == 1))
    rows = table(spark, x, np.minimum(label, 3))
    cuts = cut_points(rows, 6, 12)
    packed = forest.materialise(binned(rows, cuts, ["weight"]), "binned")
    widths = [len(c) + 1 for c in cuts]
    assert forest._bundles(packed, widths) == [[1, 2, 3, 4]]
    grown = []
    for bundles in ([], [[1, 2, 3, 4]]):
        grown.append(forest.Forest(packed, widths, 4, 5, 4, 0.8, 0.8, 1, bundles))
        grown[-1].fit()
    assert (grown[0].feature == grown[1].feature).all() and (grown[0].cut == grown[1].cut).all()
    assert np.allclose(grown[0].value, grown[1].value)


def test_a_forest_on_some_features_reads_no_others(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4)).round(2)
    rows = table(spark, x, (x[:, 1] > 0).astype(int) + (x[:, 3] + x[:, 2] > 0))
    model = forest.bin_rows(rows, 16).grow(4, 6, 3, columns=[3, 1])
    other = x.copy()
    other[:, [0, 2]] = 7.0
    scores = []
    for values in (x, other):
        given = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "i int, x array<double>")
        scored = model.transform(given.select("i", array_to_vector("x").alias("features")))
        scores.append([list(r.p) for r in scored.select("i", vector_to_array("probability").alias("p")).orderBy("i").collect()])
    assert scores[0] == scores[1] and np.ptp(scores[0], axis=0).max() > 0.5


def test_forests_grown_together_share_passes_and_counts(spark, monkeypatch):
    """Forests on other features or class weights equal those grown alone, in the passes of one of them."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 4)).round(2)
    label = (x[:, 0] > 0).astype(int) + (x[:, 1] + x[:, 2] > 0.5)
    rows = table(spark, x, label, np.array([1.0, 2.5, 4.0])[label]).withColumn("plain", F.lit(1.0))
    binned_rows = forest.bin_rows(rows, 16, ("weight", "plain"))
    given = [{"columns": c, "weight": w} for c in ([0, 1, 2], [0, 1, 2, 3]) for w in ("weight", "plain")]
    passes = []
    once = forest.Forest._splits
    monkeypatch.setattr(forest.Forest, "_splits", lambda self, level, group: passes.append(len(self._wanted(group)[0])) or once(self, level, group))
    together = binned_rows.grow_together([binned_rows.grow(3, 8, 4, later=True, **some) for some in given])
    assert len(passes) == 4 and passes[0] == 8  # the roots of all four forests draw the same rows
    for model, some in zip(together, given):
        alone = binned_rows.grow(3, 8, 4, **some)
        assert all(np.array_equal(a, b) for a, b in zip(model.fitted(), alone.fitted()))


def test_rows_are_dealt_to_tasks_as_bins(spark, monkeypatch):
    """Vectors of doubles are turned into bytes before they are sent, not after."""
    plans = []
    once = forest.blocked
    monkeypatch.setattr(forest, "blocked", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or once(df))
    x = np.random.default_rng(3).normal(size=(200, 3))
    forest.bin_rows(table(spark, x, (x[:, 0] > 0).astype(int)), 16)
    assert 0 <= plans[0].index("Repartition") < plans[0].index("MapInArrow")
