"""The batch job: repair, translate, infer, predict, evaluate, and a report of what was done."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetier.constants import (
    ALIASES,
    CANONICAL,
    CATEGORY_DEFAULTS,
    ID,
    INFERABLE,
    NUMERIC_DEFAULTS,
    TARGET,
    TEXT,
    VOTE_WEIGHT,
)
from lodgetier.functions.answers import non_english
from lodgetier.functions.scalars import identifier
from lodgetier.functions.vote import argmax
from lodgetier.operators.ensemble import join_scores, vote_or_first
from lodgetier.operators.evaluate import evaluate_tables, no_id_record, tier_distribution
from lodgetier.operators.missing import apply_inferences, apply_translations, infer_from_text, is_missing
from lodgetier.operators.schema import clean_listings, plain_name, repair_names, require_id
from lodgetier.plans.train import TierModel, with_row_text
from lodgetier.runtime import materialise
from lodgetier.sources.files import predictions_table

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class BatchResult:
    predictions: DataFrame
    evaluation: DataFrame | None
    report: DataFrame


def score_batch(
    df: DataFrame,
    tabular: TierModel,
    text: TierModel | None = None,
    external: DataFrame | None = None,
    weight: float = VOTE_WEIGHT,
    dialect: str = "serving",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, price_tier) and columns `keep` by soft vote of the tabular model and a text scorer.

    The text scorer is a model on row_text, which scores the same rows in place without a join,
    or a table (id, second) of outside scores. Rows without a second score use the first alone.
    """
    scored = tabular.probabilities(df, "first")
    if text is not None:
        scored = text.probabilities(with_row_text(scored, dialect, tabular.areas), "second")
    elif external is not None:
        scored = join_scores(scored, external)
    else:
        return scored.select(ID, argmax(F.col("first")).alias(TARGET), *keep)
    vote = vote_or_first(F.col("first"), F.col("second"), weight)
    return scored.select(ID, argmax(vote).alias(TARGET), *keep)


# What the report counts, as columns of a cleaned table.
FACTS = ("_non_english", *(f"_gap_{c}" for c in INFERABLE))


def with_facts(cleaned: DataFrame) -> DataFrame:
    """Add what the report counts, before gaps are filled."""
    return cleaned.withColumns(dict(zip(FACTS, (non_english(F.col(TEXT)), *(is_missing(c) for c in INFERABLE)))))


def prepare(
    raw: DataFrame,
    mapping: Mapping[str, str | None] | None = None,
    translations: DataFrame | None = None,
    inferences: DataFrame | None = None,
    infer_before_fill: bool = False,
    facts: bool = False,
) -> DataFrame:
    """Clean a raw table and fill gaps; with `facts`, columns tell what the cleaned table lacked.

    Missing values are inferred from descriptions and an optional inferences table. By default
    that happens after defaults were filled in, so only unknown neighbourhoods are still missing;
    infer_before_fill looks for gaps first.
    """

    def infer(df: DataFrame) -> DataFrame:
        df = infer_from_text(df)
        return apply_inferences(df, inferences) if inferences is not None else df

    def translate(df: DataFrame) -> DataFrame:
        return apply_translations(df, translations) if translations is not None else df

    if not infer_before_fill:
        cleaned = clean_listings(raw, mapping)
        return (with_facts(cleaned) if facts else cleaned).transform(translate).transform(infer)
    named = require_id(repair_names(raw, mapping))
    if TEXT in named.columns:
        named = named.transform(translate).transform(infer)
    return clean_listings(named)


def run_report(raw: DataFrame, cleaned: DataFrame, mapping: Mapping[str, str | None] | None = None) -> DataFrame:
    """(step, metric, value): what the input held and what was done to it.

    Facts about names come from the schema; all counts come from one aggregation. `cleaned` may be a table that
    holds the columns of `with_facts` already.
    """
    spark = raw.sparkSession
    names = [plain_name(c) for c in raw.columns]
    aliases = {alias: canonical for canonical, group in ALIASES.items() for alias in group}
    unknown = [c for c in names if c not in CANONICAL and c not in aliases]
    mapped = [c for c in unknown if (mapping or {}).get(c) in CANONICAL]
    present = {aliases.get(c, c) for c in names} | {(mapping or {}).get(c) for c in mapped}
    defaulted = [c for c in (*NUMERIC_DEFAULTS, *CATEGORY_DEFAULTS) if c not in present]
    facts = [
        ("schema", "columns", str(len(names))),
        ("schema", "aliases_resolved", ", ".join(f"{a} -> {c}" for a, c in aliases.items() if a in names)),
        ("schema", "unknown_mapped", ", ".join(mapped)),
        ("schema", "unknown_kept", ", ".join(c for c in unknown if c not in mapped)),
        ("schema", "defaults_applied", ", ".join(defaulted)),
    ]
    if not set(FACTS) <= set(cleaned.columns):
        cleaned = with_facts(cleaned)
    gaps = {c: F.count_if(f"_gap_{c}") for c in INFERABLE}
    any_gap = reduce(or_, (F.col(f"_gap_{c}") for c in INFERABLE))
    counts = cleaned.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("_non_english").alias("non_english"),
        F.count_if(any_gap).alias("gap_rows"),
        *[n.alias(f"gap_{c}") for c, n in gaps.items()],
    )
    gap_columns = F.concat_ws(", ", *[F.when(F.col(f"gap_{c}") > 0, F.lit(c)) for c in sorted(INFERABLE)])
    metrics = [
        ("schema", "rows", F.col("rows").cast("string")),
        ("translate", "non_english_rows", F.col("non_english").cast("string")),
        ("infer", "rows_with_gaps", F.col("gap_rows").cast("string")),
        ("infer", "columns_with_gaps", gap_columns),
    ]
    measured = counts.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(s).alias("step"), F.lit(m).alias("metric"), v.alias("value")) for s, m, v in metrics]
            )
        )
    )
    return spark.createDataFrame(facts, "step string, metric string, value string").union(measured)


def prediction_report(predictions: DataFrame) -> DataFrame:
    """(step, metric, value): predictions in all, and per tier that occurs."""
    tiers = tier_distribution(predictions)
    total = tiers.agg(F.sum("n").alias("n")).select(F.lit("predictions").alias("metric"), "n")
    found = tiers.where("n > 0").select(F.col("tier_name").alias("metric"), "n")
    return total.union(found).select(F.lit("predict").alias("step"), "metric", F.col("n").cast("string").alias("value"))


def run_batch(
    raw: DataFrame,
    tabular: TierModel,
    text: TierModel | None = None,
    labels: DataFrame | None = None,
    external: DataFrame | None = None,
    **preparation,
) -> BatchResult:
    """Score one raw table, and evaluate it when labels are given.

    The raw table is read once: predictions are written with the facts that the report counts, and evaluation and
    report read them back. Where gaps are looked for before defaults are filled in, the report reads it again.
    """
    mapping = preparation.get("mapping")
    facts = () if preparation.get("infer_before_fill") else FACTS
    ready = prepare(raw, **preparation, facts=bool(facts))
    scored = score_batch(ready, tabular, text, external, keep=facts)
    written = materialise(scored.select(identifier(F.col(ID)).alias(ID), F.col(TARGET).cast("int").alias(TARGET), *facts), "predictions")
    predictions = written.select(ID, TARGET)
    evaluation = None
    if labels is not None:
        evaluation = (
            evaluate_tables(predictions, predictions_table(labels)) if ID in labels.columns else no_id_record(labels)
        )
    cleaned = written if facts else clean_listings(raw, mapping)
    report = run_report(raw, cleaned, mapping).union(prediction_report(predictions))
    return BatchResult(predictions, evaluation, report)
