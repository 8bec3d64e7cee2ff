"""Combining two scorers' class probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetier.constants import ID, TARGET, TIERS, VOTE_WEIGHT, VOTE_WEIGHTS
from lodgetier.functions.vote import argmax, scores_to_vector, soft_vote
from lodgetier.operators.evaluate import confusion, macro_f1


def one_vector_per_id(scores: DataFrame, vector: str) -> DataFrame:
    """Mean vector of each id; for ids scored once, that is the vector itself."""
    means = [F.avg(F.get(vector, F.lit(t))).alias(f"m{t}") for t in TIERS]
    return scores.groupBy(ID).agg(*means).select(ID, F.array(*[f"m{t}" for t in TIERS]).alias(vector))


def outside_scores(df: DataFrame, text: str, scorer: Callable[[pd.Series], Sequence]) -> DataFrame:
    """(id, second) from a scorer that takes a batch of texts.

    For every text the scorer gives a list of {label, score}. A batch it fails on has no scores,
    so that a later vote uses the first scorer there.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                scores = list(scorer(batch[text]))
            except Exception:  # whatever goes wrong outside must not stop the job
                scores = [None] * len(batch)
            yield pd.DataFrame({ID: batch[ID], "scores": pd.Series(scores, index=batch.index, dtype=object)})

    schema = f"{ID} {df.schema[ID].dataType.simpleString()}, scores array<struct<label:string,score:double>>"
    listed = df.select(ID, text).mapInPandas(score, schema)
    return listed.select(ID, scores_to_vector(F.col("scores")).alias("second"))


def join_scores(first: DataFrame, second: DataFrame, left: str = "first", right: str = "second") -> DataFrame:
    """First scorer's rows with the second scorer's vector, null where it has none."""
    return first.join(one_vector_per_id(second.select(ID, right), right), ID, "left")


def vote_or_first(first: Column, second: Column, weight: float = VOTE_WEIGHT) -> Column:
    """Weighted mean; the first vector alone where the second is missing."""
    return F.when(second.isNull(), first).otherwise(soft_vote(first, second, weight))


def soft_vote_fallback(first: DataFrame, second: DataFrame, weight: float = VOTE_WEIGHT) -> DataFrame:
    """(id, price_tier) by soft vote of two score tables, row by row falling back to the first."""
    combined = vote_or_first(F.col("first"), F.col("second"), weight)
    return join_scores(first, second).select(ID, argmax(combined).alias(TARGET))


def _f1_by_weight(scored: DataFrame, truth: str, weights: Mapping[str, float]) -> DataFrame:
    """Macro F1 of each named weight: (name, macro_f1).

    Each row is scored under all weights in place and counted by its list of outcomes. Only
    those counts, a few hundred rows, are taken apart by weight.
    """
    outcomes = F.array(*[argmax(vote_or_first(F.col("first"), F.col("second"), w)) for w in weights.values()])
    counted = scored.groupBy(F.col(truth).cast("int").alias("t"), outcomes.alias("outcomes")).agg(
        F.count(F.lit(1)).alias("n")
    )
    names = F.array(*[F.lit(name) for name in weights])
    by_name = counted.select("t", "n", F.inline(F.arrays_zip(names.alias("name"), "outcomes"))).toDF(
        "t", "n", "name", "p"
    )
    return macro_f1(confusion(by_name, "name", weight=F.col("n"), truth="t", predicted="p"), "name")


def weight_sweep(scored: DataFrame, truth: str = TARGET, weights: Sequence[float] = VOTE_WEIGHTS) -> DataFrame:
    """Macro F1 for every weight of the first vector: (weight, macro_f1)."""
    swept = _f1_by_weight(scored, truth, {str(float(w)): float(w) for w in weights})
    return swept.select(F.col("name").cast("double").alias("weight"), "macro_f1")


def ensemble_compare(scored: DataFrame, weight: float = VOTE_WEIGHT, truth: str = TARGET) -> DataFrame:
    """Macro F1 of the vote and of each scorer alone: (scorer, macro_f1)."""
    swept = _f1_by_weight(scored, truth, {"ensemble": weight, "first": 1.0, "second": 0.0})
    return swept.withColumnRenamed("name", "scorer")
