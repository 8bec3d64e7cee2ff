"""Worked examples and classification prompts, one text per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetier.constants import EXAMPLE_FIELDS, ID, SEED, SHOTS_PER_TIER, TARGET, TIER_NAMES, TIERS
from lodgetier.functions.scalars import row_hash
from lodgetier.operators.sampling import per_class_sample

INSTRUCTIONS = (
    "Assign a short-term rental listing to one of four price tiers: "
    + ", ".join(f"{tier} = {name}" for tier, name in enumerate(TIER_NAMES))
    + ".\n\nExamples:\n"
)
QUESTION = "\n\nListing:\n"
ANSWER = "\n\nAnswer with one digit from 0 to 3."


def _written(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("nan"))


def _fields() -> list[Column]:
    return [F.concat(F.lit(f"{title}: "), _written(column)) for title, column in EXAMPLE_FIELDS]


def few_shot_block(labelled: DataFrame, k: int = SHOTS_PER_TIER, seed: int = SEED) -> DataFrame:
    """One row, column `block`: k example lines of each of the four tiers in shuffled order."""
    sample = per_class_sample(labelled.where(F.col(TARGET).isin(*TIERS)), k, seed=seed)
    line = F.concat(F.lit("  "), F.concat_ws(" | ", *_fields()), F.lit(" → "), _written(TARGET))
    # k lines per tier, so the list stays short whatever was sampled from.
    shuffled = sample.select(row_hash(F.col(ID), seed + 1).alias("place"), F.col(ID).alias("id"), line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("place", "id", "line")))
    return shuffled.agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("block"))


def render_prompts(df: DataFrame, block: DataFrame) -> DataFrame:
    """Add prompt: instructions, the example block and the row's own fields."""
    fields = F.concat_ws("\n", *[F.concat(F.lit("  "), f) for f in _fields()])
    prompt = F.concat(F.lit(INSTRUCTIONS), block.scalar(), F.lit(QUESTION), fields, F.lit(ANSWER))
    return df.withColumn("prompt", prompt)
