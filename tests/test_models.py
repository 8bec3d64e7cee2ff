"""Fitted models: rows kept, tiers in range, probabilities, repeatability, signal, saving, batch, stream."""

import pytest
from pyspark.sql import functions as F

from lodgetier.fixtures import raw_listings, table
from lodgetier.operators import forest, schema
from lodgetier.plans import batch, compare, train
from lodgetier.sources import files
from lodgetier.streaming import score as streaming


@pytest.fixture(scope="module")
def listings(spark):
    df = table(spark, "/root/testdata/sf0.001", "listings")
    return df.transform(schema.coerce_numeric).transform(schema.fill_categorical).transform(schema.fill_description)


@pytest.fixture(scope="module")
def model(listings):
    return train.fit_tabular_model(listings, trees=10, restarts=2)


def test_probabilities(listings, model):
    rows = model.probabilities(listings).collect()
    assert len(rows) == listings.count()
    assert all(len(r.scores) == 4 and sum(r.scores) == pytest.approx(1) and min(r.scores) >= 0 for r in rows)


def test_same_seed_same_model(listings, model):
    again = train.fit_tabular_model(listings, trees=10, restarts=2)
    key = ["property_id", "price_tier"]
    assert sorted(model.predict(listings).select(key).collect()) == sorted(again.predict(listings).select(key).collect())


@pytest.mark.parametrize("kind, trees, floor", [("forest", 20, 0.25), ("boosted", 3, 0.25), ("linear", 1, 0.25)])
def test_better_than_the_largest_class(listings, kind, trees, floor):
    fit, validation = train.split_frames(listings)
    fitted = train.fit_tabular_model(fit, kind=kind, trees=trees, restarts=2)
    assert compare.model_f1(fitted, validation) > floor


def test_a_batch_reads_the_raw_table_once(spark, listings, model):
    """Rows are counted where they are read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    raw, labels = files.split_inputs([table(spark, "/root/testdata/sf0.001", "listings")])
    rows = raw.count()
    result = batch.run_batch(raw.mapInArrow(count, raw.schema), model, labels=labels)
    report = {(r.step, r.metric): r.value for r in result.report.collect()}
    assert result.evaluation.first().n_evaluated == rows == int(report["schema", "rows"]) and seen.value == rows
    plain = {(r.step, r.metric): r.value for r in batch.run_report(raw, batch.clean_listings(raw)).collect()}
    assert plain.items() <= report.items()


def test_areas_come_from_training_rows_only(listings):
    fit, validation = train.split_frames(listings)
    assert fit.count() + validation.count() == listings.count()
    ids = fit.select("property_id").intersect(validation.select("property_id"))
    assert ids.isEmpty()


def test_save_and_load(spark, listings, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    loaded = train.TierModel.load(spark, str(tmp_path / "m"))
    key = ["property_id", "price_tier"]
    assert sorted(loaded.predict(listings).select(key).collect()) == sorted(model.predict(listings).select(key).collect())


def test_batch_with_labels(spark, listings, model):
    raw, labels = files.split_inputs([table(spark, "/root/testdata/sf0.001", "listings")])
    result = batch.run_batch(raw, model, labels=labels)
    tiers = [r.price_tier for r in result.predictions.collect()]
    assert len(tiers) == listings.count() and set(tiers) <= {0, 1, 2, 3}
    assert result.evaluation.first().n_evaluated == listings.count()
    assert result.evaluation.first().macro_f1 > 0.3
    report = {(r.step, r.metric): r.value for r in result.report.collect()}
    assert report["predict", "predictions"] == str(listings.count()) == report["schema", "rows"]


def test_batch_without_labels(spark, listings, model):
    renamed = listings.drop("price_tier").withColumnsRenamed(
        {"property_id": "id", "description": "name", "neighbourhood_group": "borough", "minimum_nights": "min_nights"}
    )
    result = batch.run_batch(renamed, model)
    assert result.evaluation is None and result.predictions.count() == listings.count()


def test_batch_with_sparse_and_blank_input(listings, model):
    sparse = listings.select("property_id", "latitude", "longitude", F.lit("").alias("description"))
    assert batch.run_batch(sparse, model).predictions.count() == listings.count()


def test_batch_with_labels_that_have_no_id(listings, model):
    result = batch.run_batch(listings.drop("price_tier"), model, labels=listings.select("price_tier"))
    assert "property_id" in result.evaluation.first().error


def test_score_batch_sources(listings, model):
    rows = listings.drop("price_tier")
    alone = {r.property_id: r.price_tier for r in batch.score_batch(rows, model).collect()}
    outside = rows.limit(100).select("property_id", F.array(*[F.lit(float(t == 3)) for t in range(4)]).alias("second"))
    ids = {r.property_id for r in outside.collect()}
    mixed = {r.property_id: r.price_tier for r in batch.score_batch(rows, model, external=outside, weight=0.0).collect()}
    assert all(mixed[i] == (3 if i in ids else alone[i]) for i in alone)


def test_text_scorer_runs_on_the_same_rows(listings, model):
    text = train.fit_row_text_model(listings, "serving", model.areas)
    scored = batch.score_batch(listings.drop("price_tier"), model, text)
    assert scored.count() == listings.count()
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_stream_equals_batch(spark, listings, model, tmp_path):
    folder, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    raw = raw_listings(spark, "/root/testdata/sf0.001").repartition(3)
    files.write_csv(raw, folder)
    for _ in range(2):  # the second run finds nothing new
        stream = streaming.listing_files(spark, folder, files_per_batch=1)
        streaming.score_stream(stream, model, out, log, until_done=True).awaitTermination()
    found = sorted(spark.read.parquet(out).select("property_id", "price_tier").collect())
    expected = batch.score_batch(batch.prepare(files.read_listings(spark, folder)), model)
    assert found == sorted(expected.collect()) and len(found) == listings.count()


def test_a_sweep_bins_its_rows_once(spark, listings, monkeypatch):
    """Every configuration grows on its own features of the same binned rows."""
    made, grown = [], []

    def binned(*a):
        made.append(real(*a))
        return made[-1]

    def grow(self, *a, **named):
        grown.append((tuple(named["columns"]), named["weight"]))
        return whole(self, *a, **named)

    real, whole = compare.bin_rows, forest.BinnedRows.grow
    monkeypatch.setattr(compare, "bin_rows", binned)
    monkeypatch.setattr(forest.BinnedRows, "grow", grow)
    fit, validation = train.split_frames(listings)
    swept = compare.geo_sweep(fit, validation, clusters=(5, 10), trees=10, restarts=1).collect()
    assert len(made) == 1 and len(set(grown)) == len(swept) == 8
    assert all(r.macro_f1 > 0.25 for r in swept)
    width = len(made[0].cuts)
    assert {len(c) for c, _ in grown} == {width - 1, width - 1 - len(compare.HOTSPOT_COLUMNS)}


def test_sweep_and_top(spark, listings):
    fit, validation = train.split_frames(listings)
    swept = compare.geo_sweep(fit, validation, clusters=(5,), trees=3, restarts=1)
    assert {(r.clusters, r.hotspots, r.balanced) for r in swept.collect()} == {
        (5, h, b) for h in (False, True) for b in (False, True)
    }
    tied = spark.createDataFrame(
        [(0.5, 5, True, True), (0.5, 10, False, True), (0.5, 10, True, False), (0.6, 5, False, False)],
        compare.SWEEP_COLUMNS,
    )
    assert [(r.clusters, r.hotspots) for r in compare.top_configurations(tied, 3).collect()] == [
        (5, False), (10, True), (10, False)
    ]


def test_unknown_names(listings):
    for call in (lambda: train.classifier("x", True), lambda: train.fit_feature_set(listings, "x")):
        with pytest.raises(ValueError):
            call()


def test_saving_twice_loads_the_second(spark, listings, tmp_path):
    first = train.fit_tabular_model(listings, clusters=3, trees=3, restarts=1)
    second = train.fit_tabular_model(listings, clusters=5, hotspots=False, trees=4, restarts=1)
    for model in (first, second):
        model.save(spark, str(tmp_path / "m"))
    loaded = train.TierModel.load(spark, str(tmp_path / "m"))
    assert loaded.areas == second.areas and loaded.hotspots is False
    assert loaded.pipeline.stages[-1].getNumTrees == 4


def test_listings_without_coordinates_are_in_the_city_centre(spark, model):
    centre = spark.createDataFrame([(1, 40.7128, -74.006), (2, None, None)], "id int, latitude double, longitude double")
    labels = {r.geo_label for r in model.areas.transform(centre).collect()}
    assert labels == {model.areas.transform(centre.select("id")).first().geo_label}


def test_a_text_model_makes_its_texts_once(spark, listings):
    """Rows are counted where they are read; weights and classifier read the counts of words."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    fitted = train.fit_text_model(listings.mapInArrow(count, listings.schema), "description")
    assert seen.value == listings.count()
    assert {len(r.scores) for r in fitted.probabilities(listings).select("scores").collect()} == {4}
