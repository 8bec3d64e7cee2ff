"""Schema repair and cleaning: any listing table to the canonical columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetier.constants import ALIASES, CANONICAL, CATEGORY_DEFAULTS, ID, NUMERIC_DEFAULTS, TARGET, TEXT
from lodgetier.functions.scalars import identifier, number


def plain_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def sources_of(columns: list[str], mapping: Mapping[str, str | None] | None = None) -> dict[str, list[str]]:
    """For each output column, the input columns that may fill it, best first.

    Canonical names come first, then aliases in their listed order, then the caller's mapping.
    Columns nothing is known about keep their own name.
    """
    sources: dict[str, list[str]] = {}
    for canonical in CANONICAL:
        found = [name for name in (canonical, *ALIASES.get(canonical, ())) if name in columns]
        if found:
            sources[canonical] = found
    taken = {c for found in sources.values() for c in found}
    for column in dict.fromkeys(columns):
        if column in taken:
            continue
        target = (mapping or {}).get(column)
        if target in CANONICAL:
            sources.setdefault(target, []).append(column)
        else:
            sources.setdefault(column, []).append(column)
    return sources


def repair_names(df: DataFrame, mapping: Mapping[str, str | None] | None = None) -> DataFrame:
    """Normalise names, resolve aliases and an optional mapping of unknown names.

    Mapping targets outside the canonical columns are ignored. Several columns for one canonical
    name are merged, the first value present winning. Everything else passes through.
    """
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    by_name: dict[str, list[str]] = {}
    for position, name in enumerate(df.columns):
        by_name.setdefault(plain_name(name), []).append(f"c{position}")
    names = [plain_name(c) for c in df.columns]
    return renamed.select(
        *[
            F.coalesce(*[F.col(c) for name in found for c in by_name[name]]).alias(target)
            for target, found in sources_of(names, mapping).items()
        ]
    )


def add_default_columns(df: DataFrame) -> DataFrame:
    """Add canonical columns that are absent, filled with their defaults."""
    absent = {c: v for c, v in (NUMERIC_DEFAULTS | CATEGORY_DEFAULTS).items() if c not in df.columns}
    return df.withColumns({c: F.lit(v) for c, v in absent.items()})


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Numeric columns as doubles; missing or unreadable values become the default."""
    return df.withColumns(
        {c: F.coalesce(number(F.col(c)), F.lit(default)) for c, default in NUMERIC_DEFAULTS.items() if c in df.columns}
    )


def fill_categorical(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            c: F.coalesce(F.col(c).cast("string"), F.lit(default))
            for c, default in CATEGORY_DEFAULTS.items()
            if c in df.columns
        }
    )


def fill_description(df: DataFrame) -> DataFrame:
    text = F.col(TEXT).cast("string") if TEXT in df.columns else F.lit(None)
    return df.withColumn(TEXT, F.coalesce(text, F.lit("")))


def require_id(df: DataFrame) -> DataFrame:
    if ID not in df.columns:
        raise ValueError(f"no {ID} column, also not under another known name: {df.columns}")
    return df.withColumn(ID, identifier(F.col(ID)))


def clean_listings(df: DataFrame, mapping: Mapping[str, str | None] | None = None) -> DataFrame:
    """The whole chain: names, defaults, numbers, categories, description.

    One projection after optimisation; no shuffle and no pass over the data of its own.
    """
    repaired = require_id(repair_names(df, mapping))
    return repaired.transform(add_default_columns).transform(coerce_numeric).transform(
        fill_categorical
    ).transform(fill_description)


def feature_projection(df: DataFrame) -> DataFrame:
    """Features only: without id and target."""
    return df.drop(ID, TARGET)
