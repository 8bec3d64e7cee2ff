"""Class-probability vectors: arrays of one double per tier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgetier.constants import TIERS


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row rather than wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(scores: Column) -> Column:
    raised = _with(F.array_max(scores), lambda top: F.transform(scores, lambda z: F.exp(z - top)))

    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
        return _with(total, lambda t: F.transform(powers, lambda e: e / t))

    return _with(raised, shares)


def argmax(scores: Column) -> Column:
    """Index of the largest entry, the first one on ties."""
    return _with(scores, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def soft_vote(first: Column, second: Column, weight: Column | float) -> Column:
    """Weighted mean of two vectors."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.zip_with(first, second, lambda a, b: w * a + (1 - w) * b)


def scores_to_vector(scores: Column) -> Column:
    """List of {label, score} to a vector; the number after the last underscore is the index.

    Tiers that are not listed get 0; no list gives no vector.
    """

    def entry(tier: int) -> Column:
        of_tier = F.filter(
            scores, lambda s: F.element_at(F.split(s["label"], "_"), -1).try_cast("int") == F.lit(tier)
        )
        return F.coalesce(F.try_element_at(of_tier, F.lit(-1))["score"].cast("double"), F.lit(0.0))

    return F.when(scores.isNotNull(), F.array(*[entry(tier) for tier in TIERS]))
