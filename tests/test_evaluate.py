"""Scores against a plain calculation; ensembles; geography; features."""

import random

import pytest
from pyspark.sql import functions as F

from lodgetier.constants import HOTSPOTS, TIERS
from lodgetier.operators import ensemble, evaluate, features, geo


def plain_f1(pairs):
    present = {t for pair in pairs for t in pair}
    scores = []
    for c in present:
        hit = sum(1 for t, p in pairs if t == p == c)
        support, called = sum(1 for t, _ in pairs if t == c), sum(1 for _, p in pairs if p == c)
        scores.append(2 * hit / (support + called))
    return sum(scores) / len(scores)


def counts(spark, pairs):
    return evaluate.confusion(spark.createDataFrame(pairs, "true_tier int, price_tier int"))


@pytest.mark.parametrize("classes", [(0, 1, 2, 3), (0, 2), (1,), (0, 1, 5)])
def test_macro_f1(spark, classes):
    rng = random.Random(len(classes))
    pairs = [(rng.choice(classes), rng.choice(classes)) for _ in range(200)]
    assert evaluate.macro_f1(counts(spark, pairs)).first().macro_f1 == pytest.approx(plain_f1(pairs))


def test_report(spark):
    rows = {r.name: r for r in evaluate.class_report(counts(spark, [(0, 0), (0, 1), (1, 1), (2, 1)])).collect()}
    assert list(rows) == ["Budget", "Standard", "Premium", "Ultra-Luxury", "accuracy", "macro avg", "weighted avg"]
    assert (rows["Budget"].precision, rows["Budget"].recall, rows["Budget"].support) == (1.0, 0.5, 2)
    assert rows["Standard"].precision == pytest.approx(1 / 3)
    assert (rows["Ultra-Luxury"].f1, rows["Ultra-Luxury"].support) == (0.0, 0)
    assert rows["accuracy"].f1 == 0.5 and rows["accuracy"].support == 4
    assert rows["macro avg"].recall == pytest.approx((0.5 + 1 + 0 + 0) / 4)
    assert rows["weighted avg"].recall == pytest.approx(0.5)


def test_report_with_a_foreign_class(spark):
    rows = {r.name: r for r in evaluate.class_report(counts(spark, [(0, 0), (7, 0), (1, 7)])).collect()}
    assert "accuracy" not in rows
    micro = rows["micro avg"]
    assert (micro.precision, micro.recall, micro.support) == (0.5, 0.5, 2)


def test_report_text(spark):
    record = evaluate.evaluation_record(counts(spark, [(0, 0), (0, 1), (1, 1), (2, 1)])).first()
    assert record.macro_f1 == pytest.approx(round((2 / 3 + 0.5 + 0) / 3, 4))
    assert record.n_evaluated == 4 and record.error is None
    assert record.report.splitlines()[2] == "      Budget       1.00      0.50      0.67         2"
    assert record.report.splitlines()[7] == "    accuracy                           0.50         4"


def test_repeated_ids_multiply_and_unmatched_drop(spark):
    schema = "property_id long, price_tier int"
    predictions = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (5, 1), (8, 3)], schema)
    labels = spark.createDataFrame([(1, 0), (1, 3), (5, 1), (9, 3)], schema)
    joined = evaluate.eval_join(predictions, labels)
    found = sorted(tuple(r) for r in joined.collect())
    assert found == [(1, 0, 0, 2), (1, 0, 3, 2), (1, 2, 0, 1), (1, 2, 3, 1), (5, 1, 1, 1)]
    plain = predictions.join(labels.withColumnRenamed("price_tier", "t"), "property_id").count()
    assert evaluate.evaluate_tables(predictions, labels).first().n_evaluated == plain


def test_constant_against_other_constant_scores_zero(spark):
    ids = spark.range(50).withColumnRenamed("id", "property_id")
    record = evaluate.evaluate_tables(ids.withColumn("price_tier", F.lit(1)), ids.withColumn("price_tier", F.lit(2))).first()
    assert record.macro_f1 == 0 and record.n_evaluated == 50


def test_nothing_matches(spark):
    schema = "property_id long, price_tier int"
    record = evaluate.evaluate_tables(
        spark.createDataFrame([(1, 1)], schema), spark.createDataFrame([(2, 1)], schema)
    ).first()
    assert record.error and record.n_evaluated == 0 and record.report is None and record.macro_f1 is None


def test_evaluation_does_not_recompute_its_input(spark, sf):
    from lodgetier.fixtures import table

    listings = table(spark, sf, "listings")
    plan = evaluate.evaluate_tables(table(spark, sf, "predictions"), listings)._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Join") == 1


def scored(spark):
    rows = [
        (1, 0, [0.6, 0.4, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]),
        (2, 1, [0.5, 0.5, 0.0, 0.0], None),
        (3, 2, [0.0, 0.0, 0.3, 0.7], [0.0, 0.0, 1.0, 0.0]),
    ]
    return spark.createDataFrame(rows, "property_id long, price_tier int, first array<double>, second array<double>")


def test_vote_falls_back_row_by_row(spark):
    df = scored(spark)
    first, second = df.select("property_id", "first"), df.where("second IS NOT NULL").select("property_id", "second")
    found = {r.property_id: r.price_tier for r in ensemble.soft_vote_fallback(first, second).collect()}
    assert found == {1: 1, 2: 0, 3: 2}
    assert {r.price_tier for r in ensemble.soft_vote_fallback(first, second.limit(0)).collect()} == {0, 3}


def test_second_scores_are_averaged_per_id(spark):
    first = spark.createDataFrame([(1, [0.4, 0.6, 0.0, 0.0])] * 2, "property_id long, first array<double>")
    second = spark.createDataFrame(
        [(1, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0])], "property_id long, second array<double>"
    )
    joined = ensemble.join_scores(first, second).collect()
    assert len(joined) == 2 and joined[0].second == [0.5, 0.5, 0.0, 0.0]


def test_outside_scorer(spark):
    def scorer(texts):
        if (texts == "bad").any():
            raise RuntimeError("unreachable")
        return [[{"label": f"LABEL_{len(t)}", "score": 1.0}] for t in texts]

    rows = spark.createDataFrame([(1, "aa"), (2, "bad"), (3, "")], "property_id long, row_text string").repartition(3, "property_id")
    found = {r.property_id: r.second for r in ensemble.outside_scores(rows, "row_text", scorer).collect()}
    assert found[1] in ([0.0, 0.0, 1.0, 0.0], None) and found[2] is None
    alone = ensemble.outside_scores(rows.where("property_id <> 2"), "row_text", scorer)
    assert {r.property_id: r.second for r in alone.collect()} == {1: [0.0, 0.0, 1.0, 0.0], 3: [1.0, 0.0, 0.0, 0.0]}


def test_sweep_matches_single_votes(spark):
    df = scored(spark)
    swept = {r.weight: r.macro_f1 for r in ensemble.weight_sweep(df, weights=[0.0, 0.5, 1.0]).collect()}
    assert swept[0.0] == pytest.approx(plain_f1([(0, 1), (1, 0), (2, 2)]))
    assert swept[1.0] == pytest.approx(plain_f1([(0, 0), (1, 0), (2, 3)]))
    compared = {r.scorer: r.macro_f1 for r in ensemble.ensemble_compare(df).collect()}
    assert compared == {"first": swept[1.0], "second": swept[0.0], "ensemble": swept[0.5]}


@pytest.mark.parametrize(
    "mean, label",
    [
        (0.0, "budget area"),
        (0.7499, "budget area"),
        (0.75, "standard area"),
        (1.5, "premium area"),
        (2.25, "luxury district"),
        (3.0, "luxury district"),
        (-1.0, "luxury district"),
        (None, "luxury district"),
        (float("nan"), "luxury district"),
    ],
)
def test_tier_label(spark, mean, label):
    df = spark.createDataFrame([(mean,)], "m double")
    assert df.select(geo.tier_label(F.col("m"))).first()[0] == label


def test_hotspots_are_their_own_nearest_centre(spark):
    df = spark.createDataFrame(list(HOTSPOTS.values()), "latitude double, longitude double")
    rows = geo.hotspot_distances(df).withColumn(
        "c", geo.nearest_centre(F.col("latitude"), F.col("longitude"), tuple(HOTSPOTS.values()))
    ).collect()
    assert [r.c for r in rows] == list(range(5))
    assert [r[f"dist_{name}"] for r, name in zip(rows, HOTSPOTS)] == [0.0] * 5


def test_areas(spark, tmp_path):
    rows = [(x + i / 1000, x + i / 900, t) for x, t in ((0.0, 0), (10.0, 1), (20.0, 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, price_tier int")
    areas = geo.fit_areas(df, 3, restarts=3)
    assert areas == geo.fit_areas(df, 3, restarts=3)
    assert areas.labels == ("budget area", "standard area", "luxury district")
    areas.save(spark, str(tmp_path / "areas"))
    assert geo.AreaModel.load(spark, str(tmp_path / "areas")) == areas
    found = areas.transform(spark.createDataFrame([(9.0, 9.0), (None, 1.0)], "latitude double, longitude double"))
    assert [r.geo_label for r in found.collect()] == ["standard area", "luxury district"]


def test_empty_cluster_is_listed(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0)], "cluster int, price_tier int, latitude double, longitude double")
    rows = {r.cluster: r for r in geo.cluster_summary(df, 2).collect()}
    assert (rows[1].n, rows[1].mean_tier, rows[1].geo_label) == (0, None, "luxury district")


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(3,)] * 2, "price_tier int")
    assert {r.price_tier: r.weight for r in features.class_weights(df).collect()} == {0: 8 / 12, 3: 2.0}
    weighted = df.select("price_tier", features.sample_weight(df).alias("w")).distinct().collect()
    assert {r.price_tier: r.w for r in weighted} == {0: 8 / 12, 3: 2.0}


def test_codes_follow_sorted_order(spark, monkeypatch):
    names = [f"n{i * 7919 % 1000:03}" for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in names] * 2, "c string")
    codes = {r.value: r.code for r in features.ordinal_codes(df, "c").collect()}
    assert codes == {n: i for i, n in enumerate(sorted(names))}
    unseen = spark.createDataFrame([("n003",), ("zzz",), (None,)], "c string")
    table = features.ordinal_codes(df, "c")
    for limit in (200_000, 5):
        monkeypatch.setattr("lodgetier.runtime.BROADCAST_ROWS", limit)
        found = {r.c: r.code for r in features.attach_code(unseen, table, "c", "code").collect()}
        assert found == {"n003": 3, "zzz": -1, None: -1}


def test_encoders(spark):
    train = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "h string, o string, v double")
    new = spark.createDataFrame([("b", "y", 5.0), ("q", "q", 6.0), (None, None, 7.0)], "h string, o string, v double")
    encoded = features.fit_tabular(train, ["v"], ["h"], ["o"]).transform(new).collect()
    assert [list(r.features.toArray()) for r in encoded] == [[5, 1, 0, 1], [6, -1, 0, 0], [7, -1, 0, 0]]


def test_too_many_categories(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_CATEGORIES", 3)
    df = spark.range(100).selectExpr("CAST(id AS STRING) AS h", "id * 1e0 AS v")
    with pytest.raises(ValueError):
        features.fit_tabular(df, ["v"], ["h"], [])


def test_tiers():
    assert TIERS == (0, 1, 2, 3)


def test_rows_without_a_tier_are_not_judged(spark):
    predicted = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, None)], "property_id long, price_tier int")
    truth = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 2)], "property_id long, price_tier int")
    record = evaluate.evaluate_tables(predicted, truth).first()
    assert (record.macro_f1, record.n_evaluated) == (1.0, 2)
    assert evaluate.dropped_rows(predicted, truth).first() == (1, 1)


def test_examples_come_from_the_four_tiers(spark):
    from lodgetier.operators import prompts, sampling

    rows = [(i, None if i % 2 else i // 2 % 4) for i in range(80)] + [(99, 7)]
    df = spark.createDataFrame(rows, "property_id long, price_tier int")
    assert {r.price_tier for r in sampling.per_class_sample(df, 2).collect()} == {0, 1, 2, 3, 7}
    blank = {c: None for _, c in prompts.EXAMPLE_FIELDS}
    wide = df.selectExpr("*", *[f"cast(null as string) AS {c}" for c in blank if c not in df.columns])
    block = prompts.few_shot_block(wide, 3).first().block
    assert len(block.split("\n")) == 12 and "nan\n" not in block.split("→")[-1]
