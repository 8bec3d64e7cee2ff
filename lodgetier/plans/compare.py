"""Comparing models: leaderboard, area sweep, held-out check."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetier.constants import (
    BASE_NUMERIC,
    CLUSTER_RESTARTS,
    HOTSPOT_COLUMNS,
    ONE_HOT,
    ORDINAL,
    SWEEP_CLUSTERS,
    TARGET,
    TIERS,
)
from lodgetier.functions.vote import argmax
from lodgetier.operators.evaluate import class_report, confusion, macro_f1
from lodgetier.operators.features import fit_tabular, sample_weight
from lodgetier.operators.forest import ForestModel, Planned, bin_rows
from lodgetier.operators.geo import AreaModel, fit_all_centres, hotspot_distances, label_centres
from lodgetier.plans.train import BINS, DEPTH, FEATURE_SETS, TierModel, fit_feature_set, fit_tabular_model, with_flags
from lodgetier.runtime import materialise

SWEEP_TREES = 200
SWEEP_COLUMNS = "macro_f1 double, clusters int, hotspots boolean, balanced boolean"


def scored_counts(model: TierModel, labelled: DataFrame) -> DataFrame:
    """Confusion counts of a model on labelled rows; truth and prediction stay on one row."""
    rows = model.predict(labelled.withColumn("true_tier", F.col(TARGET)))
    return confusion(rows)


def model_f1(model: TierModel, labelled: DataFrame) -> float:
    return macro_f1(scored_counts(model, labelled)).first().macro_f1


def leaderboard(
    train: DataFrame, validation: DataFrame, names: Sequence[str] = FEATURE_SETS, trees: int = 100, parallelism: int = 4
) -> DataFrame:
    """(approach, macro_f1) per feature set, best first; a few are fitted at a time."""
    train, validation = with_flags(train), with_flags(validation)
    with ThreadPoolExecutor(parallelism) as pool:
        fit = inheritable_thread_target(train.sparkSession)(lambda name: fit_feature_set(train, name, trees))
        models = list(pool.map(fit, names))
    parts = [
        macro_f1(scored_counts(model, validation)).select(F.lit(name).alias("approach"), "macro_f1")
        for name, model in zip(names, models)
    ]
    return reduce(DataFrame.union, parts).orderBy(F.desc("macro_f1"))


def geo_sweep(
    train: DataFrame,
    validation: DataFrame,
    clusters: Sequence[int] = SWEEP_CLUSTERS,
    trees: int = SWEEP_TREES,
    restarts: int = CLUSTER_RESTARTS,
    parallelism: int = 4,
) -> DataFrame:
    """Macro F1 for every cluster count, with and without hotspot distances and balancing.

    The areas of all cluster counts are fitted in shared passes, and each shared by its four configurations. Rows are
    encoded and binned once for all, and all forests grow in the same passes. A few are scored at a time.
    """
    return _swept(train, validation, clusters, trees, _areas(train, clusters, restarts), parallelism)


def _areas(train: DataFrame, clusters: Sequence[int], restarts: int) -> dict[int, AreaModel]:
    return {k: label_centres(train, centres) for k, centres in fit_all_centres(train, clusters, restarts).items()}


def _swept(
    train: DataFrame, validation: DataFrame, clusters: Sequence[int], trees: int, areas: dict[int, AreaModel], parallelism: int
) -> DataFrame:
    labels = {k: f"geo_label_{k}" for k in clusters}

    def located(df: DataFrame) -> DataFrame:
        for k, name in labels.items():
            df = areas[k].transform(df).withColumnRenamed("geo_label", name)
        return hotspot_distances(df)

    # Rows are encoded and binned once, with the features of all configurations; each takes its own.
    everything = located(train.drop("geo_label"))
    labelled = everything.where(F.col(TARGET).isNotNull())
    ordinal = [c for c in ORDINAL if c != "geo_label"]
    encoders = fit_tabular(everything, [*BASE_NUMERIC, *HOTSPOT_COLUMNS], ONE_HOT, [*ordinal, *labels.values()])
    columns = [F.col(TARGET).cast("int").alias("label"), sample_weight(labelled).alias("balanced"), F.lit(1.0).alias("plain")]
    rows = materialise(encoders.transform(labelled).select("features", *columns), "sweep")
    classes = max(len(TIERS), int(rows.agg(F.max("label")).first()[0] or 0) + 1)
    binned = bin_rows(rows, BINS, ("balanced", "plain"))
    held_out = encoders.transform(located(validation.drop("geo_label"))).select("features", F.col(TARGET).alias("true_tier"))
    held_out = materialise(held_out, "held-out")
    before = len(BASE_NUMERIC) + len(HOTSPOT_COLUMNS)
    ends = before + len(ordinal)

    configurations = list(product(clusters, (False, True), (False, True)))

    def planned(k: int, hotspots: bool, balanced: bool) -> Planned:
        own = [*range(len(BASE_NUMERIC)), *(range(len(BASE_NUMERIC), before) if hotspots else ()), *range(before, ends)]
        own += [ends + list(labels).index(k), *range(ends + len(labels), len(binned.cuts))]
        return binned.grow(classes, trees, DEPTH, columns=own, weight="balanced" if balanced else "plain", later=True)

    models = binned.grow_together([planned(*c) for c in configurations])

    def measured(model: ForestModel) -> float:
        scored = model.transform(held_out).select("true_tier", argmax(vector_to_array("probability")).alias(TARGET))
        return macro_f1(confusion(scored)).first().macro_f1

    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(inheritable_thread_target(train.sparkSession)(measured), models))
    return train.sparkSession.createDataFrame([(f1, *c) for f1, c in zip(found, configurations)], SWEEP_COLUMNS)


def top_configurations(sweep: DataFrame, n: int = 5) -> DataFrame:
    """The n best; ties go to more clusters, then hotspots, then balancing."""
    return sweep.orderBy(F.desc("macro_f1"), F.desc("clusters"), F.desc("hotspots"), F.desc("balanced")).limit(n)


def best_configuration(
    train: DataFrame, validation: DataFrame, clusters: Sequence[int] = SWEEP_CLUSTERS, **settings
) -> tuple[DataFrame, TierModel]:
    """The sweep, and its best configuration fitted once more."""
    trees, restarts = settings.get("trees", SWEEP_TREES), settings.get("restarts", CLUSTER_RESTARTS)
    areas = _areas(train, clusters, restarts)
    sweep = _swept(train, validation, clusters, trees, areas, settings.get("parallelism", 4))
    best = top_configurations(sweep, 1).first()
    fitted = fit_tabular_model(train, best.clusters, best.hotspots, best.balanced, trees=trees, areas=areas[best.clusters])
    return sweep, fitted


def holdout_eval(model: TierModel, holdout: DataFrame) -> DataFrame:
    """Report of a fitted model on labelled rows it has not seen."""
    return class_report(scored_counts(model, holdout))
