"""The registered queries: each operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodgetier.constants import BASE_NUMERIC, HOTSPOTS, ID, ONE_HOT, SWEEP_CLUSTERS, TARGET, TEXT, TIER_NAMES
from lodgetier.fixtures import raw_listings, table, vectors
from lodgetier.functions import answers, phrases, vote
from lodgetier.functions.scalars import safe_int
from lodgetier.operators import (
    ensemble,
    evaluate,
    features,
    geo,
    knn,
    missing,
    prompts,
    sampling,
    schema,
)
from lodgetier.plans import batch, compare, train
from lodgetier.runtime import materialise, scratch_path
from lodgetier.sources import files
from lodgetier.streaming import score as streaming

Query = Callable[[SparkSession, str], DataFrame]

# Rounds of the registered boosted model; each is six passes of mostly fixed cost, see the README.
BOOSTED_ROUNDS = 50

# Rows in the files that are written with mixed headers, before they are dealt to three of them.
FILE_ROWS = 500_000

CENTRES = (*HOTSPOTS.values(), (41.9, -70.0))

_queries: dict[str, Query] = {}


def query(function: Query) -> Query:
    _queries[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_queries)


def _listings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "listings")


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    """Listings ready for features, with their tier."""
    return _listings(spark, sf).transform(schema.coerce_numeric).transform(schema.fill_categorical).transform(
        schema.fill_description
    )


def _long(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.col("n").cast("bigint"))


# Sources and sinks


def _raw_csv(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "raw-csv")
    files.write_csv(raw_listings(spark, sf), path)
    return path


@query
def read_listings(spark, sf):
    read = files.read_listings(spark, _raw_csv(spark, sf))
    return read.toDF("id", "name", "borough", "area", "type", "min_nights", "reviews", "lat", "lng", "extra_col")


@query
def na_tokens(spark, sf):
    return files.null_na_tokens(table(spark, sf, "raw"))


@query
def predictions_out(spark, sf):
    path = scratch_path(spark, "predictions-csv")
    files.write_predictions(table(spark, sf, "predictions"), path)
    return spark.read.schema(f"{ID} long, {TARGET} int").csv(path, header=True)


@query
def records_json(spark, sf):
    path = scratch_path(spark, "records")
    listings = _listings(spark, sf)
    files.write_records(listings, path)
    return files.read_records(spark, path, listings.schema)


@query
def split_inputs(spark, sf):
    data, labels = files.split_inputs([table(spark, sf, "predictions"), _listings(spark, sf)])
    about_data = data.agg(
        F.lit("data").alias("role"),
        F.count(F.lit(1)).alias("n"),
        F.count(TEXT).alias("described"),
        F.lit(None).cast("bigint").alias("tier_sum"),
    )
    return about_data.union(
        labels.agg(F.lit("labels"), F.count(F.lit(1)), F.lit(None).cast("bigint"), F.sum(TARGET).cast("bigint"))
    )


def _agreement(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(n, same): rows found, and how many of them have the expected tier."""
    both = found.join(expected.withColumnRenamed(TARGET, "expected"), ID)
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(TARGET).eqNullSafe(F.col("expected"))).alias("same")
    )


@query
def model_roundtrip(spark, sf):
    listings = _clean(spark, sf)
    path = scratch_path(spark, "model")
    model = train.fit_tabular_model(listings)
    model.save(spark, path)
    loaded = train.TierModel.load(spark, path)
    return _agreement(loaded.predict(listings).select(ID, TARGET), model.predict(listings).select(ID, TARGET))


@query
def read_mixed_headers(spark, sf):
    """Files with columns in other orders, under other names and twice but for case, as one table."""
    folder = scratch_path(spark, "mixed-csv")
    raw = raw_listings(spark, sf)
    raw = raw.repartition(max(1, -(-raw.count() // FILE_ROWS)))  # a file with line breaks inside quotes is read by one task
    third = F.pmod(F.col("id"), F.lit(3))
    files.write_csv(raw.where(third == 0), f"{folder}/a")
    turned = raw.select(*reversed(raw.columns)).withColumnsRenamed({"lat": "Latitude", "Min Nights": "min_nights_required"})
    files.write_csv(turned.where(F.pmod(F.col("id"), F.lit(3)) == 1), f"{folder}/b")
    both = raw.where(third == 2).toDF(*[f"c{i}" for i in range(len(raw.columns))])
    first, second = (F.when(F.pmod(F.col("c0"), F.lit(2)) == k, F.col("c1")) for k in (0, 1))
    written = both.select("c0", first.alias("x"), second.alias("y"), *both.columns[2:])
    _write_with_header(written, ["id", "NAME", "name", *raw.columns[2:]], f"{folder}/c")
    return schema.repair_names(files.read_listings(spark, folder)).select(
        ID, TEXT, "neighbourhood_group", "neighbourhood", "room_type", "minimum_nights", "number_of_reviews", "latitude", "longitude"
    )


def _write_with_header(df: DataFrame, names: list[str], path: str) -> None:
    """CSV under names that a table can't have, since they differ in case only; a file for each partition."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([",".join(names)], pa.string())], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, ["value"])

    df.select(F.concat_ws(",", *quoted).alias("value")).mapInArrow(headed, "value string").write.text(path)


@query
def stream_score(spark, sf):
    folder, output, checkpoint = (scratch_path(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    files.write_csv(raw_listings(spark, sf), folder)
    model = train.fit_tabular_model(_clean(spark, sf))
    tables = {"translations": table(spark, sf, "translations"), "inferences": table(spark, sf, "inferences")}
    arriving = streaming.listing_files(spark, folder)
    streaming.score_stream(arriving, model, output, checkpoint, until_done=True, **tables).awaitTermination()
    streamed = spark.read.parquet(output).select(ID, TARGET)
    at_rest = batch.run_batch(files.read_listings(spark, folder), model, **tables).predictions
    return _agreement(streamed, at_rest)


# Schema repair and cleaning


@query
def repair_schema(spark, sf):
    return schema.repair_names(raw_listings(spark, sf))


@query
def map_unknown_columns(spark, sf):
    raw = raw_listings(spark, sf).withColumnRenamed("type", "Kind of Room")
    mapping = {"kind_of_room": "room_type", "extra_col": "not_a_column"}
    return schema.repair_names(raw, mapping).select(ID, TEXT, "neighbourhood", "extra_col", "room_type")


@query
def add_default_columns(spark, sf):
    return schema.add_default_columns(_listings(spark, sf).select(ID, TEXT, "latitude", "longitude"))


@query
def coerce_numeric(spark, sf):
    renamed = table(spark, sf, "raw").select(
        "id",
        F.col("min_nights").alias("minimum_nights"),
        F.col("reviews").alias("number_of_reviews"),
        F.col("lat").alias("latitude"),
    )
    return schema.coerce_numeric(renamed)


@query
def fill_categorical(spark, sf):
    columns = (ID, "neighbourhood_group", "neighbourhood", "room_type")
    return schema.fill_categorical(_listings(spark, sf).select(*columns))


@query
def fill_description(spark, sf):
    return schema.fill_description(_listings(spark, sf).select(ID, TEXT))


@query
def feature_projection(spark, sf):
    return schema.feature_projection(_listings(spark, sf))


@query
def clean_listings(spark, sf):
    return schema.clean_listings(raw_listings(spark, sf))


# Language and missing values


@query
def non_english_flag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", answers.non_english(F.col("text")).alias("non_english"))


@query
def needs_translation(spark, sf):
    return missing.needs_translation(_listings(spark, sf)).select(ID, TEXT)


@query
def apply_translations(spark, sf):
    listings = _listings(spark, sf).select(ID, TEXT)
    return missing.apply_translations(listings, table(spark, sf, "translations"))


@query
def missing_columns(spark, sf):
    listings = _listings(spark, sf)
    return listings.select(ID, F.concat_ws(",", missing.missing_columns(listings)).alias("missing"))


@query
def infer_from_text(spark, sf):
    return missing.infer_from_text(_listings(spark, sf)).select(ID, "neighbourhood_group", "room_type")


@query
def apply_inferences(spark, sf):
    listings = _listings(spark, sf).select(ID, "neighbourhood", TARGET)
    return missing.apply_inferences(listings, table(spark, sf, "inferences"))


# Text


@query
def safe_int_values(spark, sf):
    raw = table(spark, sf, "raw")
    return raw.select(
        "id",
        safe_int(F.col("min_nights")).alias("nights"),
        safe_int(F.col("reviews")).alias("reviews"),
        safe_int(F.col("lat")).alias("lat"),
        safe_int(F.col("lng")).alias("lng"),
    )


def _raw_phrase(column: str, phrase: Callable) -> Query:
    return lambda spark, sf: table(spark, sf, "raw").select("id", phrase(F.col(column)).alias("phrase"))


def _phrase(column: str, phrase: Callable) -> Query:
    return lambda spark, sf: _listings(spark, sf).select(ID, phrase(F.col(column)).alias("phrase"))


_queries["safe_int"] = _queries.pop("safe_int_values")
_queries["phrase_min_nights"] = _raw_phrase("min_nights", phrases.nights_phrase)
_queries["phrase_reviews"] = _raw_phrase("reviews", phrases.reviews_phrase)
_queries["phrase_availability"] = _phrase("availability_365", phrases.availability_phrase)
_queries["phrase_availability_reviews"] = _phrase(
    "availability_365", lambda c: phrases.availability_phrase(c, F.col("number_of_reviews"))
)
_queries["phrase_host"] = _phrase("calculated_host_listings_count", phrases.host_phrase)
_queries["qual_reviews"] = _raw_phrase("reviews", phrases.worded_reviews)
_queries["qual_host"] = _phrase("calculated_host_listings_count", phrases.worded_host)
_queries["qual_min_nights"] = _raw_phrase("min_nights", phrases.worded_nights)


@query
def qual_room_type(spark, sf):
    both = table(spark, sf, "newcomers").select(ID, "room_type").union(_listings(spark, sf).select(ID, "room_type"))
    return both.select(ID, phrases.worded_room_type(F.col("room_type")).alias("phrase"))


@query
def training_medians(spark, sf):
    return features.training_medians(_listings(spark, sf))


@query
def qual_availability(spark, sf):
    medians = features.training_medians(_listings(spark, sf)).select("availability_365").scalar()
    return _phrase("availability_365", lambda c: phrases.worded_availability(c, medians))(spark, sf)


def _areas(spark: SparkSession, sf: str) -> geo.AreaModel:
    return geo.label_centres(_listings(spark, sf), CENTRES)


@query
def row_text_full(spark, sf):
    located = _areas(spark, sf).transform(_listings(spark, sf))
    return located.select(ID, phrases.row_text(located, "full").alias("text"))


@query
def row_text_serving(spark, sf):
    located = _areas(spark, sf).transform(_listings(spark, sf))
    return located.select(ID, phrases.row_text(located, "serving").alias("text"))


@query
def row_text_plain(spark, sf):
    listings = _listings(spark, sf)
    return listings.select(ID, phrases.row_text(listings, "plain").alias("text"))


@query
def row_text_qualitative(spark, sf):
    listings = _listings(spark, sf)
    return listings.select(ID, phrases.row_text(listings, "worded").alias("text"))


@query
def area_phrase(spark, sf):
    located = _areas(spark, sf).transform(_listings(spark, sf))
    return located.select(ID, phrases.area_phrase(F.col("geo_label")).alias("phrase"))


@query
def text_flags(spark, sf):
    return train.with_flags(_listings(spark, sf).select(ID, TEXT)).drop(TEXT)


@query
def text_flags_documents(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", *[flag.alias(name) for name, flag in answers.text_flags(F.col("text")).items()]
    )


@query
def parse_flag_json(spark, sf):
    return table(spark, sf, "responses").select(ID, answers.parsed_flags(F.col("response")).alias("flags")).select(
        ID, "flags.*"
    )


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "responses").select(ID, answers.parsed_tier(F.col("response")).alias(TARGET))


@query
def parse_tier(spark, sf):
    return _parsed(spark, sf)


@query
def few_shot_block(spark, sf):
    return prompts.few_shot_block(table(spark, sf, "partly"))


@query
def render_prompts(spark, sf):
    block = prompts.few_shot_block(table(spark, sf, "partly"))
    return prompts.render_prompts(table(spark, sf, "newcomers"), block).select(ID, "prompt")


# Geography


@query
def hotspot_distances(spark, sf):
    measured = geo.hotspot_distances(_listings(spark, sf))
    return measured.select(ID, *[F.round(f"dist_{name}", 9).alias(f"dist_{name}") for name in HOTSPOTS])


@query
def geo_kmeans(spark, sf):
    """Areas that came to rest: every centre is the mean of the rows nearest to it."""
    listings = _listings(spark, sf)
    centres = geo.fit_centres(listings)
    assigned = listings.withColumn("cluster", geo.nearest_centre(F.col("latitude"), F.col("longitude"), centres))
    found = geo.cluster_summary(assigned, len(centres))
    own = F.get(F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.col("cluster"))
    away = F.greatest(F.abs(F.col("mean_lat") - own[0]), F.abs(F.col("mean_lon") - own[1]))
    return found.agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n"), (F.max(away) < 1e-6).alias("settled")
    )


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    return _listings(spark, sf).withColumn(
        "cluster", geo.nearest_centre(F.col("latitude"), F.col("longitude"), CENTRES)
    )


@query
def nearest_centre(spark, sf):
    return _assigned(spark, sf).select(ID, "cluster")


@query
def cluster_summary(spark, sf):
    summary = geo.cluster_summary(_assigned(spark, sf), len(CENTRES))
    return _long(summary).withColumns({c: F.round(c, 6) for c in ("mean_tier", "mean_lat", "mean_lon")})


@query
def tier_label(spark, sf):
    means = _listings(spark, sf).groupBy("neighbourhood", "number_of_reviews").agg(F.avg(TARGET).alias("m"))
    return means.select("neighbourhood", "number_of_reviews", geo.tier_label(F.col("m")).alias("geo_label"))


@query
def geo_label(spark, sf):
    return _areas(spark, sf).transform(_listings(spark, sf)).select(ID, "geo_label")


@query
def knn_geo_tier(spark, sf):
    return knn.knn_tier(table(spark, sf, "located"), table(spark, sf, "newcomers")).select(ID, "geo_tier")


def _out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    return knn.knn_tier_out_of_fold(materialise(sampling.kfold(table(spark, sf, "located")), "folds"))


@query
def knn_geo_tier_oof(spark, sf):
    return _out_of_fold(spark, sf).select(ID, "geo_tier")


@query
def location_prefix(spark, sf):
    located = train.with_area_text(table(spark, sf, "located"), table(spark, sf, "newcomers"))
    return located.select(ID, "combined")


@query
def leakage_rate(spark, sf):
    rate = evaluate.agreement_rate(_out_of_fold(spark, sf), "geo_tier", TARGET)
    return rate.select(F.round("agreement", 6).alias("agreement"))


@query
def geo_tier_counts(spark, sf):
    counts = _out_of_fold(spark, sf).groupBy("geo_tier").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("geo_tier")


# Sampling


@query
def stratified_split(spark, sf):
    return sampling.stratified_split(_listings(spark, sf).select(ID, TARGET))


@query
def per_class_sample(spark, sf):
    return sampling.per_class_sample(table(spark, sf, "partly").select(ID, TARGET))


@query
def kfold(spark, sf):
    return sampling.kfold(_listings(spark, sf).select(ID))


@query
def subset_n(spark, sf):
    return sampling.subset_n(_listings(spark, sf).select(ID), 50)


# Features


@query
def one_hot(spark, sf):
    encoders = features.fit_tabular(_listings(spark, sf), [], ONE_HOT, [])
    encoded = encoders.transform(table(spark, sf, "newcomers"))
    widths = {c: encoded.schema[f"_{c}_hot"].metadata["ml_attr"]["num_attrs"] for c in ONE_HOT}
    return encoded.select(
        ID,
        *[
            F.get(vector_to_array(f"_{c}_hot"), F.lit(i)).cast("int").alias(f"{c}_{i}")
            for c in ONE_HOT
            for i in range(widths[c])
        ],
    )


@query
def ordinal_code(spark, sf):
    codes = features.ordinal_codes(_listings(spark, sf), "neighbourhood")
    newcomers = table(spark, sf, "newcomers").select(ID, "neighbourhood")
    return features.attach_code(newcomers, codes, "neighbourhood", "code")


@query
def assemble_features(spark, sf):
    rows = train.with_flags(_clean(spark, sf))
    encoders = features.fit_tabular(rows, BASE_NUMERIC, ONE_HOT, ["neighbourhood"], list(answers.FLAGS))
    array = vector_to_array("features")
    return encoders.transform(rows).select(
        ID,
        F.size(array).alias("width"),
        F.round(F.aggregate(array, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.aggregate(F.transform(array, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("by_place"),
    )


@query
def text_vectors(spark, sf):
    documents = table(spark, sf, "documents")
    vectorised = features.fit_text(documents, "text").transform(documents)
    counted = F.aggregate(vector_to_array("_counts"), F.lit(0.0), lambda a, x: a + x)
    return vectorised.select(
        "doc_id", counted.cast("bigint").alias("words"), F.size(vector_to_array("text_vector")).alias("width")
    )


@query
def class_weights(spark, sf):
    return features.class_weights(_listings(spark, sf)).withColumn("weight", F.round("weight", 9))


@query
def class_weights_quality(spark, sf):
    return features.class_weights(table(spark, sf, "labels"), "quality").withColumn("weight", F.round("weight", 9))


@query
def sample_weights(spark, sf):
    listings = _listings(spark, sf).select(ID, TARGET)
    return listings.select(ID, F.round(features.sample_weight(listings), 9).alias("weight"))


# Models


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return train.split_frames(_clean(spark, sf))


def _checked(report: DataFrame, telling: bool = True) -> DataFrame:
    """What is determined of a report: its lines and supports, scores in range, and with `telling` features a
    macro F1 above that of always calling the largest tier."""
    lines = report.withColumn("valid", F.least("precision", "recall", "f1") >= 0).withColumn(
        "valid", F.col("valid") & (F.greatest("precision", "recall", "f1") <= 1)
    )
    if not telling:
        return lines.select("position", "name", "support", "valid")
    tiers = F.col("position") < 4
    facts = report.agg(
        F.max(F.when(F.col("name") == "macro avg", F.col("f1"))).alias("macro"),
        (F.max(F.when(tiers, F.col("support"))) / F.sum(F.when(tiers, F.col("support")))).alias("p"),
    ).select((F.col("macro") > 2 * F.col("p") / (1 + F.col("p")) / 4).alias("beats_largest"))
    return lines.select("position", "name", "support", "valid", facts.scalar().alias("beats_largest"))


def _report(model: train.TierModel, validation: DataFrame, telling: bool = True) -> DataFrame:
    return _checked(compare.holdout_eval(model, validation), telling)


def _tier_in_range(df: DataFrame) -> DataFrame:
    return df.select(ID, F.col(TARGET).isin(0, 1, 2, 3).alias("valid"))


@query
def train_tabular(spark, sf):
    fit, validation = _split(spark, sf)
    return _report(train.fit_tabular_model(fit), validation)


@query
def train_boosted(spark, sf):
    fit, validation = _split(spark, sf)
    return _report(train.fit_tabular_model(fit, kind="boosted", trees=BOOSTED_ROUNDS), validation)


@query
def predict_tabular(spark, sf):
    model = train.fit_tabular_model(_clean(spark, sf))
    newcomers = schema.clean_listings(table(spark, sf, "newcomers"))
    return _tier_in_range(model.predict(newcomers))


@query
def predict_proba(spark, sf):
    model = train.fit_tabular_model(_clean(spark, sf))
    scored = model.probabilities(schema.clean_listings(table(spark, sf, "newcomers")))
    inside = F.forall("scores", lambda p: (p >= 0) & (p <= 1))
    return scored.select(ID, F.size("scores").alias("tiers"), inside.alias("valid"))


@query
def predict_proba_sums(spark, sf):
    rows = schema.clean_listings(table(spark, sf, "newcomers"))
    model = train.fit_tabular_model(_clean(spark, sf))
    scored = model.probabilities(rows)
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return scored.select(
        ID,
        F.size("scores").alias("tiers"),
        F.round(total, 6).alias("total"),
        (F.array_min("scores") >= 0).alias("none_negative"),
    )


@query
def linear_probe(spark, sf):
    """Every vector, scored by a probe that was fitted without it."""
    embeddings = table(spark, sf, "embeddings")
    as_vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select("vec_id", F.col("label"), array_to_vector(as_vector).alias("features"))
    rows = materialise(sampling.kfold(rows, 3, "vec_id"), "probe")
    parts = []
    for fold in range(3):
        model = train.TierModel(train.fit_classifier(rows.where(F.col("fold") != fold), None, "linear", label="label"))
        parts.append(model.predict(rows.where(F.col("fold") == fold)))
    return reduce(DataFrame.union, parts).select("vec_id", "label", F.col(TARGET).isin(*range(10)).alias("valid"))


@query
def text_classifier(spark, sf):
    """Every document, with the quality that a model of the labelled ones sees in it."""
    documents = table(spark, sf, "documents")
    model = train.fit_text_model(documents.join(table(spark, sf, "labels"), "doc_id"), "text", label="quality")
    return model.predict(documents).select("doc_id", F.col(TARGET).isin(0, 1).alias("valid"))


def _row_text_classifier(dialect: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        fit, validation = _split(spark, sf)
        areas = geo.fit_areas(fit) if dialect in ("full", "serving") else None
        model = train.fit_row_text_model(fit, dialect, areas)
        return _report(model, train.with_row_text(validation, dialect, areas))

    return run


_queries["fused_text_classifier"] = _row_text_classifier("full")
_queries["fused_text_classifier_plain"] = _row_text_classifier("plain")
_queries["fused_text_classifier_qualitative"] = _row_text_classifier("worded")


@query
def area_text_classifier(spark, sf):
    fit, validation = train.split_frames(train.with_area_text(_clean(spark, sf)))
    return _report(train.fit_text_model(fit, "combined"), validation)


def _feature_set(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        fit, validation = _split(spark, sf)
        model = train.fit_feature_set(train.with_flags(fit), name)
        return _report(model, train.with_flags(validation), "tabular" in name)

    return run


_queries["vectors_only"] = _feature_set("vectors")
_queries["vectors_tabular"] = _feature_set("vectors+tabular")
_queries["flags_tabular"] = _feature_set("tabular+flags")


# Ensembling


@query
def scores_to_proba(spark, sf):
    scores = table(spark, sf, "first_scores")
    pairs = [F.struct(F.lit(f"LABEL_{t}").alias("label"), F.col(f"p{t}").alias("score")) for t in (2, 0, 3, 1)]
    listed = scores.select(ID, F.filter(F.array(*pairs), lambda s: s["score"] > 0.2).alias("scores"))
    vector = listed.select(ID, vote.scores_to_vector(F.col("scores")).alias("v"))
    return vector.select(ID, *[F.get("v", F.lit(t)).alias(f"p{t}") for t in range(4)])


@query
def softmax(spark, sf):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    shares = table(spark, sf, "embeddings").select("vec_id", vote.softmax(logits).alias("p"))
    return shares.select(
        "vec_id",
        vote.argmax(F.col("p")).alias("top"),
        F.round(F.array_max("p"), 9).alias("p_top"),
        F.round(F.array_min("p"), 9).alias("p_low"),
    )


@query
def argmax(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", vote.argmax(F.col("embedding")).alias("top"))


def _scorers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    first = vectors(table(spark, sf, "first_scores"), "first")
    return first, vectors(table(spark, sf, "second_scores"), "second").drop(TARGET)


@query
def soft_vote(spark, sf):
    joined = ensemble.join_scores(*_scorers(spark, sf)).where(F.col("second").isNotNull())
    mixed = joined.select(ID, vote.soft_vote(F.col("first"), F.col("second"), 0.6).alias("v"))
    return mixed.select(ID, *[F.round(F.get("v", F.lit(t)), 9).alias(f"p{t}") for t in range(4)])


@query
def soft_vote_fallback(spark, sf):
    return ensemble.soft_vote_fallback(*_scorers(spark, sf))


@query
def weight_sweep(spark, sf):
    swept = ensemble.weight_sweep(ensemble.join_scores(*_scorers(spark, sf)))
    return swept.withColumn("macro_f1", F.round("macro_f1", 6))


@query
def ensemble_compare(spark, sf):
    compared = ensemble.ensemble_compare(ensemble.join_scores(*_scorers(spark, sf)))
    return compared.withColumn("macro_f1", F.round("macro_f1", 6))


@query
def score_batch(spark, sf):
    listings = _clean(spark, sf)
    tabular = train.fit_tabular_model(listings)
    text = train.fit_row_text_model(listings, "serving", tabular.areas)
    return _tier_in_range(batch.score_batch(schema.clean_listings(table(spark, sf, "newcomers")), tabular, text))


# Evaluation and reports


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    joined = evaluate.eval_join(table(spark, sf, "predictions"), table(spark, sf, "partly"))
    return evaluate.confusion(joined, weight=F.col("n"))


@query
def eval_join(spark, sf):
    return evaluate.eval_join(table(spark, sf, "predictions"), table(spark, sf, "partly"))


@query
def eval_empty(spark, sf):
    strangers = table(spark, sf, "predictions").withColumn(ID, -1_000_000_000 - F.col(ID))
    return evaluate.evaluate_tables(strangers, _listings(spark, sf))


@query
def class_report(spark, sf):
    report = evaluate.class_report(_counts(spark, sf))
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query
def macro_f1(spark, sf):
    return evaluate.macro_f1(_counts(spark, sf)).select(F.round("macro_f1", 6).alias("macro_f1"))


@query
def evaluation_record(spark, sf):
    return evaluate.evaluation_record(_counts(spark, sf))


@query
def evaluate_tables(spark, sf):
    return evaluate.evaluate_tables(_parsed(spark, sf), table(spark, sf, "partly"))


@query
def tier_distribution(spark, sf):
    return _long(evaluate.tier_distribution(table(spark, sf, "predictions")))


@query
def leaderboard(spark, sf):
    board = compare.leaderboard(*_split(spark, sf))
    return board.select("approach", F.col("macro_f1").between(0, 1).alias("valid"))


@query
def geo_sweep(spark, sf):
    swept = compare.geo_sweep(*_split(spark, sf), clusters=SWEEP_CLUSTERS)
    return swept.select("clusters", "hotspots", "balanced", F.col("macro_f1").between(0, 1).alias("valid"))


@query
def sweep_top5(spark, sf):
    swept = ensemble.weight_sweep(ensemble.join_scores(*_scorers(spark, sf)))
    as_sweep = swept.select(
        "macro_f1",
        F.round(F.col("weight") * 10).cast("int").alias("clusters"),
        (F.col("weight") > 0.55).alias("hotspots"),
        (F.col("weight") < 0.35).alias("balanced"),
    )
    return compare.top_configurations(as_sweep).withColumn("macro_f1", F.round("macro_f1", 6))


def _reloaded_report(spark: SparkSession, model: train.TierModel, held_out_rows: DataFrame) -> DataFrame:
    """Report of a model that was saved and loaded, on rows that were written under an alias and read back."""
    saved, held_out = scratch_path(spark, "model"), scratch_path(spark, "held-out")
    model.save(spark, saved)
    files.write_csv(held_out_rows.withColumnRenamed("minimum_nights", "min_nights_required"), held_out)
    rows = schema.clean_listings(files.read_listings(spark, held_out))
    return _report(train.TierModel.load(spark, saved), rows.withColumn(TARGET, safe_int(F.col(TARGET)).cast("int")))


@query
def holdout_eval(spark, sf):
    fit, validation = _split(spark, sf)
    return _reloaded_report(spark, train.fit_tabular_model(fit), validation)


@query
def best_configuration(spark, sf):
    """The best of the whole sweep, refitted, saved, loaded and scored on rows of a file."""
    fit, validation = _split(spark, sf)
    _, best = compare.best_configuration(fit, validation, SWEEP_CLUSTERS)
    return _reloaded_report(spark, best, validation)


@query
def fitted_ensemble(spark, sf):
    """Weight sweep over a fitted tabular and a fitted text model on validation rows, with their agreement at weight 1."""
    fit, validation = _split(spark, sf)
    tabular = train.fit_tabular_model(fit)
    text = train.fit_row_text_model(fit, "serving", tabular.areas)
    scored = tabular.probabilities(validation, "first")
    scored = text.probabilities(train.with_row_text(scored, "serving", tabular.areas), "second")
    scored = materialise(scored.select(ID, TARGET, "first", "second"), "scores")
    swept = ensemble.weight_sweep(scored)
    alone = scored.agg(
        F.count_if(vote.argmax(vote.soft_vote(F.col("first"), F.col("second"), 1.0)) == vote.argmax(F.col("first"))).alias("same"),
        F.count(F.lit(1)).alias("n"),
    )
    in_range = F.count_if((F.col("macro_f1") >= 0) & (F.col("macro_f1") <= 1)).alias("scored")
    return swept.agg(F.count(F.lit(1)).alias("weights"), in_range).join(alone)


@query
def run_report(spark, sf):
    raw = raw_listings(spark, sf)
    return batch.run_report(raw, schema.clean_listings(raw))


@query
def run_batch(spark, sf):
    """The report of a batch and its evaluation; of what a model decides only what is determined."""
    listings = _listings(spark, sf)
    raw, labels = files.split_inputs([listings])
    model = train.fit_tabular_model(_clean(spark, sf))
    result = batch.run_batch(
        raw,
        model,
        labels=labels,
        translations=table(spark, sf, "translations"),
        inferences=table(spark, sf, "inferences"),
    )
    evaluation = result.evaluation.select(
        F.lit("evaluate").alias("step"),
        F.explode(
            F.create_map(
                F.lit("macro_f1"),
                F.col("macro_f1").cast("string"),
                F.lit("n_evaluated"),
                F.col("n_evaluated").cast("string"),
                F.lit("report"),
                F.col("report"),
            )
        ).alias("metric", "value"),
    )
    report = result.report.union(evaluation)
    tiers = report.where("step = 'predict' and metric <> 'predictions'")
    whole = tiers.select(F.lit("predict"), F.lit("sum of tiers"), F.sum(F.col("value").cast("bigint")).over(Window.partitionBy()).cast("string"))
    names = reduce(and_, (F.contains("value", F.lit(name)) for name in TIER_NAMES))
    told = (
        F.when(F.col("metric") == "macro_f1", F.col("value").cast("double").between(0, 1).cast("string"))
        .when(F.col("metric") == "report", names.cast("string"))
        .when((F.col("step") == "predict") & (F.col("metric") != "predictions"), F.lit("counted"))
        .otherwise(F.col("value"))
    )
    return report.withColumn("value", told).union(whole.distinct())
