"""Language and missing-value work: finding the rows in need and applying what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lodgetier.constants import ID, INFERABLE, MISSING_TEXTS, TEXT, VOCABULARY
from lodgetier.functions.answers import first_mentioned, non_english


def needs_translation(df: DataFrame) -> DataFrame:
    return df.where(non_english(F.col(TEXT)))


def apply_translations(df: DataFrame, translations: DataFrame) -> DataFrame:
    """Replace descriptions by `translated` of the same id; rows in need only.

    One scan and one lazy join: rows whose description isn't flagged, or without an id, match nothing. They are
    dealt by a hash of the row, since a missing key would bring all of them to one task. Several translations of
    one id are reduced to the alphabetically last before the join. Adaptive execution splits what one key leaves
    to a task.
    """
    flagged = F.col(TEXT).isNotNull() & non_english(F.col(TEXT))
    # An aggregate, since a plain zero would be taken out of the join's keys.
    zero = F.min(F.lit(0).cast("long")).alias("_dealt")
    table = translations.groupBy(F.col(ID).alias("_wanted")).agg(F.max("translated").alias("_translated"), zero)
    plain = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, AtomicType)]
    dealt = F.when(flagged & F.col(ID).isNotNull(), F.lit(0)).otherwise(F.xxhash64(*plain).bitwiseOR(F.lit(1)))
    keyed = df.withColumns({"_wanted": F.when(flagged, F.col(ID)), "_dealt": dealt})
    return keyed.join(table, ["_wanted", "_dealt"], "left").withColumn(TEXT, F.coalesce("_translated", TEXT)).select(*df.columns)


def is_missing(column: str) -> Column:
    return F.col(column).isNull() | F.col(column).isin(*MISSING_TEXTS)


def missing_columns(df: DataFrame) -> Column:
    """Names of the inferable columns that hold no value in a row."""
    return F.array_compact(
        F.array(*[F.when(is_missing(c), F.lit(c)) for c in INFERABLE if c in df.columns])
    )


def infer_from_text(df: DataFrame) -> DataFrame:
    """Fill missing boroughs and room types with the valid value the description mentions first."""
    return df.withColumns(
        {
            c: F.when(is_missing(c), F.coalesce(first_mentioned(F.col(TEXT), c), F.col(c))).otherwise(F.col(c))
            for c in VOCABULARY
            if c in df.columns
        }
    )


def apply_inferences(df: DataFrame, inferences: DataFrame) -> DataFrame:
    """Overwrite inferable columns from (id, col_name, col_value); other columns are ignored.

    The inferences are pivoted to one row per id, with partial aggregation, before the join.
    Several values for one cell are reduced to the alphabetically last.
    """
    columns = [c for c in INFERABLE if c in df.columns]
    wide = (
        inferences.where(F.col("col_name").isin(columns))
        .groupBy(ID)
        .agg(*[F.max(F.when(F.col("col_name") == c, F.col("col_value"))).alias(f"new_{c}") for c in columns])
    )
    return (
        df.join(wide, ID, "left")
        .withColumns({c: F.coalesce(f"new_{c}", c) for c in columns})
        .select(*df.columns)
    )
