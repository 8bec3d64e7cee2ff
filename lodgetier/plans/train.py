"""Training and applying tier models with Spark ML."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgetier.constants import (
    BASE_NUMERIC,
    BEST_CLUSTERS,
    FLAGS,
    HOTSPOT_COLUMNS,
    ONE_HOT,
    ORDINAL,
    SEED,
    TARGET,
    TEXT,
    TIERS,
)
from lodgetier.functions.answers import text_flags
from lodgetier.functions.phrases import location_prefix, row_text
from lodgetier.functions.vote import argmax
from lodgetier.operators.boosting import ROUNDS, fit_softmax
from lodgetier.operators.dense import fit_dense_text
from lodgetier.operators.features import fit_count_weights, fit_tabular, sample_weight, text_counts
from lodgetier.operators.forest import fit_forest
from lodgetier.operators.geo import AreaModel, fit_areas, hotspot_distances
from lodgetier.operators.knn import knn_tier, knn_tier_out_of_fold
from lodgetier.operators.sampling import kfold, stratified_split
from lodgetier.runtime import materialise

TREES = 100
DEPTH = 6
BINS = 128  # split candidates per feature; coordinates need more than the usual 32
WIDE_BINS = 32  # for thousands of text features
WIDE = 1024  # vectors of more features stay sparse and are left to Spark's own forest


@dataclass(frozen=True)
class TierModel:
    """Fitted encoders and classifier, with the area model its features need."""

    pipeline: PipelineModel
    areas: AreaModel | None = None
    hotspots: bool = False

    def features(self, df: DataFrame) -> DataFrame:
        if self.areas:
            df = self.areas.transform(df)
        return hotspot_distances(df) if self.hotspots else df

    def probabilities(self, df: DataFrame, output: str = "scores") -> DataFrame:
        """Add the class-probability vector; the input's other columns stay as they are."""
        scored = self.pipeline.transform(self.features(df))
        return scored.select(*df.columns, vector_to_array(F.col("probability")).alias(output))

    def predict(self, df: DataFrame) -> DataFrame:
        """Add or replace price_tier."""
        kept = [c for c in df.columns if c != TARGET]
        scored = self.probabilities(df, "_scores")
        return scored.select(*kept, argmax(F.col("_scores")).alias(TARGET))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write to a fresh folder below `path`, then point to it; until then the model saved before is valid."""
        version = uuid.uuid4().hex
        self.pipeline.write().save(f"{path}/{version}/pipeline")
        if self.areas:
            self.areas.save(spark, f"{path}/{version}/areas")
        settings = [(time.time_ns(), version, self.hotspots, self.areas is not None)]
        columns = "saved bigint, version string, hotspots boolean, areas boolean"
        spark.createDataFrame(settings, columns).coalesce(1).write.mode("append").parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TierModel:
        """The model saved last."""
        settings = spark.read.parquet(f"{path}/settings").orderBy(F.desc("saved")).first()
        place = f"{path}/{settings.version}"
        areas = AreaModel.load(spark, f"{place}/areas") if settings.areas else None
        return TierModel(PipelineModel.load(f"{place}/pipeline"), areas, settings.hotspots)


def classifier(kind: str, weighted: bool, features: str = "features", trees: int = TREES, bins: int = BINS):
    """forest or linear; boosted models are fitted by `fit_softmax`."""
    weight = {"weightCol": "_weight"} if weighted else {}
    common = {"labelCol": TARGET, "featuresCol": features} | weight
    if kind == "forest":
        return RandomForestClassifier(
            numTrees=trees,
            maxDepth=DEPTH,
            maxBins=bins,
            subsamplingRate=0.8,
            featureSubsetStrategy="0.8",
            seed=SEED,
            **common,
        )
    if kind == "linear":
        return LogisticRegression(family="multinomial", maxIter=50, regParam=0.01, **common)
    raise ValueError(f"unknown kind {kind!r}")


def fit_classifier(
    df: DataFrame,
    encoders: PipelineModel | None,
    kind: str = "forest",
    balanced: bool = True,
    features: str = "features",
    trees: int = TREES,
    label: str = TARGET,
    bins: int = BINS,
) -> PipelineModel:
    """Fit on encoded rows. The encoded rows are written once and reread by every pass.

    kind       forest, linear, or boosted: `trees` rounds of trees for all classes under one softmax
    """
    labelled = df.where(F.col(label).isNotNull())
    encoded = encoders.transform(labelled) if encoders else labelled
    weight = sample_weight(labelled, label) if balanced else F.lit(1.0)
    rows = encoded.select(features, F.col(label).cast("double").alias(TARGET), weight.alias("_weight"))
    rows = materialise(rows, "training")
    some = rows.select(features).first() if kind == "forest" else None
    if kind == "boosted" or some is not None and len(some[0]) <= WIDE:
        highest = rows.agg(F.max(TARGET)).first()[0]
        classes = max(len(TIERS), int(highest or 0) + 1)
        ready = rows.select(F.col(features).alias("features"), F.col(TARGET).cast("int").alias("label"), F.col("_weight").alias("weight"))
        if kind == "boosted":
            model = fit_softmax(ready, classes=classes, rounds=trees, bins=bins)[0]
            model.set(model.featuresCol, features)
        else:
            model = fit_forest(ready, classes, trees, DEPTH, bins, features=features)
    else:
        model = classifier(kind, balanced, features, trees, bins).fit(rows)
    return PipelineModel([*(encoders.stages if encoders else []), model])


def fit_tabular_model(
    train: DataFrame,
    clusters: int | None = BEST_CLUSTERS,
    hotspots: bool = True,
    balanced: bool = True,
    kind: str = "forest",
    trees: int | None = None,
    areas: AreaModel | None = None,
    restarts: int = 10,
    extra: Sequence[str] = (),
) -> TierModel:
    """Tabular features with areas and hotspot distances; areas are fitted on these rows only.

    By default a forest has `TREES` trees and a boosted model `ROUNDS` rounds.
    """
    trees = trees or (ROUNDS if kind == "boosted" else TREES)
    if clusters and areas is None:
        areas = fit_areas(train, clusters, restarts)
    bare = TierModel(PipelineModel([]), areas, hotspots)
    rows = bare.features(train)
    encoders = fit_tabular(
        rows,
        [*BASE_NUMERIC, *(HOTSPOT_COLUMNS if hotspots else ())],
        ONE_HOT,
        ORDINAL if areas else [c for c in ORDINAL if c != "geo_label"],
        extra,
    )
    return TierModel(fit_classifier(rows, encoders, kind, balanced, trees=trees), areas, hotspots)


def fit_text_model(
    train: DataFrame,
    column: str = TEXT,
    kind: str = "linear",
    balanced: bool = True,
    label: str = TARGET,
    trees: int = TREES,
) -> TierModel:
    """Classifier on one text column. Texts are made and split into words once; all later passes read the counts."""
    counter = text_counts(column)
    counted = materialise(counter.transform(train.select(column, label)).select("_counts", label), "counts")
    fitted = fit_classifier(counted, fit_count_weights(counted), kind, balanced, "text_vector", trees, label, WIDE_BINS)
    return TierModel(PipelineModel([*counter.stages, *fitted.stages]))


def with_row_text(df: DataFrame, dialect: str, areas: AreaModel | None = None) -> DataFrame:
    """Add row_text; pass the same dialect for training and scoring."""
    located = areas.transform(df) if areas else df
    return located.withColumn("row_text", row_text(located, dialect)).select(*df.columns, "row_text")


def fit_row_text_model(train: DataFrame, dialect: str = "full", areas: AreaModel | None = None) -> TierModel:
    """Classifier on whole listings written as sentences."""
    return fit_text_model(with_row_text(train, dialect, areas), "row_text")


def with_area_text(train: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Add geo_tier and combined, the description led by the area's tier.

    Without `queries`, training rows get their tier out of fold; else `queries` are located
    by all training rows.
    """
    if queries is None:
        located = knn_tier_out_of_fold(materialise(kfold(train), "folds")).drop("fold")
    else:
        located = knn_tier(train, queries)
    return located.withColumn("combined", location_prefix(F.col("geo_tier"), F.col(TEXT)))


def with_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(text_flags(F.col(TEXT)))


FEATURE_SETS = ("tabular", "vectors", "vectors+tabular", "tabular+flags")


def fit_feature_set(train: DataFrame, name: str, trees: int = TREES) -> TierModel:
    """Trees on one of the compared feature sets; unweighted, without areas or distances.

    The input must hold the flag columns (see with_flags) for tabular+flags.
    """
    ordinal = [c for c in ORDINAL if c != "geo_label"]
    if name == "vectors":
        text = PipelineModel([fit_dense_text(train, TEXT)])
        return TierModel(fit_classifier(train, text, "forest", False, "text_vector", trees))
    stages = []
    extra: list[str] = []
    rows = train
    if name == "vectors+tabular":
        stages = [fit_dense_text(train, TEXT)]
        extra, rows = ["text_vector"], stages[0].transform(train)
    elif name == "tabular+flags":
        extra = list(FLAGS)
    elif name != "tabular":
        raise ValueError(f"unknown feature set {name!r}")
    tabular = fit_tabular(rows, BASE_NUMERIC, ONE_HOT, ordinal, extra)
    encoders = PipelineModel([*stages, *tabular.stages])
    return TierModel(fit_classifier(train, encoders, "forest", balanced=False, trees=trees))


def split_frames(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, validation), written once so that every later fit reads the same rows."""
    split = materialise(stratified_split(df), "split")
    return (
        split.where(~F.col("is_validation")).drop("is_validation"),
        split.where("is_validation").drop("is_validation"),
    )
