"""Numbers from text, clean strings, portable hashing and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgetier.constants import BLANKS, NUMBER_PATTERN, SEED


def number(value: Column) -> Column:
    """Double from a text or number; anything that is not a plain finite number is null.

    The type test is decided while planning, so numeric columns skip the text handling.
    """
    text = value.cast("string")
    parsed = F.when(text.rlike(NUMBER_PATTERN), F.btrim(text, F.lit(BLANKS)).try_cast("double"))
    read = F.when(F.typeof(value) == "string", parsed).otherwise(value.try_cast("double"))
    return F.when(F.abs(read) < float("inf"), read)


def safe_int(value: Column) -> Column:
    """Whole number, truncated towards zero; null where there is none."""
    return number(value).try_cast("bigint")


def identifier(value: Column) -> Column:
    """Row id as a long; digits are read directly so that large ids keep every digit."""
    text = value.cast("string")
    return F.coalesce(F.btrim(text, F.lit(BLANKS)).try_cast("bigint"), safe_int(text))


def stripped(value: Column) -> Column:
    """Text without white space at both ends; null when nothing is left."""
    return F.nullif(F.btrim(value.cast("string"), F.lit(BLANKS)), F.lit(""))


def row_hash(key: Column, seed: int = SEED) -> Column:
    """60 pseudo-random bits per key, equal in every engine that has md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def banded(n: Column, bands: Sequence[tuple[int | None, str]]) -> Column:
    """Phrase of the first band whose upper bound holds `n`; "{n}" in it becomes the figure."""
    chosen = None
    for upper, phrase in bands:
        before, hole, after = phrase.partition("{n}")
        text = F.concat(F.lit(before), n.cast("string"), F.lit(after)) if hole else F.lit(phrase)
        test = n.isNotNull() if upper is None else n <= upper
        chosen = F.when(test, text) if chosen is None else chosen.when(test, text)
    return chosen
