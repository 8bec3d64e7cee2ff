"""Category codes, class weights, text vectors and feature assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.base import Transformer
from pyspark.ml.feature import (
    IDF,
    HashingTF,
    OneHotEncoder,
    RegexTokenizer,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgetier.constants import BASE_NUMERIC, MEDIANS, ONE_HOT, ORDINAL, TARGET
from lodgetier.operators.sampling import class_counts
from lodgetier.runtime import materialise, small_or_spread_join

# A model column with more values than this is free text, not a category.
MAX_CATEGORIES = 100_000
TEXT_DIMENSIONS = 4096


def balanced_weights(counts: dict[str | None, int]) -> dict[str | None, float]:
    """n / (classes * n_class) for the classes present."""
    present = {c: n for c, n in counts.items() if c is not None}
    total = sum(present.values())
    return {c: total / (len(present) * n) for c, n in present.items()}


def class_weights(df: DataFrame, by: str = TARGET) -> DataFrame:
    """One row per class: class, rows, balanced weight."""
    counts = df.where(F.col(by).isNotNull()).groupBy(by).count()
    everything = Window.partitionBy()  # over the few classes, not over the rows
    return counts.select(
        by,
        F.col("count").alias("n"),
        (F.sum("count").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("count"))).alias("weight"),
    )


def sample_weight(df: DataFrame, by: str = TARGET) -> Column:
    """Balanced weight of each row's class, as a lookup inside the projection."""
    weights = balanced_weights(class_counts(df, by))
    pairs = [F.lit(x) for pair in weights.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(by).cast("string"))


def training_medians(df: DataFrame) -> DataFrame:
    """One row: the median of each count the wording without figures is anchored on."""
    return exact_medians(df, list(MEDIANS))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of each column, null without values.

    Values are counted in the tasks and the counts put in order by ranges, so that no task holds the distinct
    values of a column: the ranges' sums say in which one a median lies, its own running sum says where.
    """
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = df.select(listed.alias("e")).select("e.*").where("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, "name", "value").withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged, "counts")
    sums = ranged.groupBy("name", "range").agg(F.sum("n").alias("held"))  # a row per column and range
    ordered = Window.partitionBy("name").orderBy("range")
    placed = sums.select(
        "name", "range", "held", (F.sum("held").over(ordered) - F.col("held")).alias("before"),
        F.sum("held").over(Window.partitionBy("name")).alias("total"),
    )
    first, second = F.expr("(total + 1) div 2"), F.expr("(total + 2) div 2")  # places, from 1, of the two middle values
    met = ranged.join(F.broadcast(placed), ["name", "range"]).where((F.col("before") < second) & (F.col("before") + F.col("held") >= first))
    inside = Window.partitionBy("name", "range").orderBy("value")
    upto = F.col("before") + F.sum("n").over(inside)
    found = met.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
    middle = [F.max(F.when((F.col("from") < place) & (F.col("upto") >= place), F.col("value"))) for place in (first, second)]
    medians = found.groupBy("name").agg(((middle[0] + middle[1]) / 2).alias("median"))
    return medians.agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in columns])


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """Dictionary of a column: value and its position in sorted order.

    Values are sorted in ranges over the cluster and numbered by range offset plus position
    inside the range, so the dictionary may be larger than one task could hold.
    """
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    in_range = (1 << 33) - 1
    parts = values.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = materialise(
        values.repartitionByRange(int(parts), "value")
        .sortWithinPartitions("value")
        .select(
            "value",
            F.spark_partition_id().alias("range"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(in_range)).alias("position"),
        ),
        "codes",
    )
    sizes = ranged.groupBy("range").count()  # one row per range
    offsets = sizes.select(
        "range", (F.sum("count").over(Window.partitionBy().orderBy("range")) - F.col("count")).alias("offset")
    )
    return ranged.join(F.broadcast(offsets), "range").select(
        "value", (F.col("offset") + F.col("position")).alias("code")
    )


def attach_code(df: DataFrame, codes: DataFrame, column: str, output: str) -> DataFrame:
    """Add the code of a column; -1 for values that are not in the dictionary."""
    table = codes.select(F.col("value").alias(column), F.col("code").alias(output))
    return small_or_spread_join(df, table, [column]).withColumn(output, F.coalesce(output, F.lit(-1)))


def fit_tabular(
    df: DataFrame,
    numeric: Sequence[str] = BASE_NUMERIC,
    one_hot: Sequence[str] = ONE_HOT,
    ordinal: Sequence[str] = ORDINAL,
    extra: Sequence[str] = (),
    output: str = "features",
) -> PipelineModel:
    """Encoders for the tabular features, as one fitted pipeline.

    one_hot      0/1 per value seen in fitting; an unseen value gives zeros only
    ordinal      position in sorted order; an unseen value gives -1
    extra        columns to append as they are: numbers or vectors
    """
    categories = [*one_hot, *ordinal]
    widths = df.agg(*[F.approx_count_distinct(c).alias(c) for c in categories]).first().asDict() if categories else {}
    too_wide = {c: n for c, n in widths.items() if n > MAX_CATEGORIES}
    if too_wide:
        raise ValueError(f"too many values for a category: {too_wide}")
    stages: list[Transformer] = []
    blocks = [*numeric]
    if categories:
        indexer = StringIndexer(
            inputCols=categories,
            outputCols=[f"_{c}_index" for c in categories],
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        ).fit(df)
        stages.append(indexer)
        labels = dict(zip(categories, indexer.labelsArray))
        codes = ", ".join(
            f"CASE WHEN _{c}_index = {len(labels[c])} THEN -1D ELSE _{c}_index END AS _{c}_code" for c in ordinal
        )
        if ordinal:
            stages.append(SQLTransformer(statement=f"SELECT *, {codes} FROM __THIS__"))
            blocks += [f"_{c}_code" for c in ordinal]
        # A column with a single value would make the encoder fail; it carries no signal.
        useful = [c for c in one_hot if len(labels[c]) > 0]
        if useful:
            encoder = OneHotEncoder(
                inputCols=[f"_{c}_index" for c in useful],
                outputCols=[f"_{c}_hot" for c in useful],
                dropLast=True,
                handleInvalid="error",
            )
            indexed = PipelineModel(stages).transform(df)
            stages.append(encoder.fit(indexed))
            blocks += [f"_{c}_hot" for c in useful]
    blocks += list(extra)
    stages.append(VectorAssembler(inputCols=blocks, outputCol=output))
    return PipelineModel(stages)


def text_counts(column: str, dimensions: int = TEXT_DIMENSIONS) -> PipelineModel:
    """Adds _counts, the hashed word counts of a text; nothing is fitted."""
    tokenizer = RegexTokenizer(
        inputCol=column, outputCol="_words", pattern=r"[\p{L}\p{N}]+", gaps=False, minTokenLength=1
    )
    return PipelineModel([tokenizer, HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions)])


def fit_count_weights(counted: DataFrame, output: str = "text_vector") -> PipelineModel:
    """_counts weighted by inverse document frequency."""
    return PipelineModel([IDF(inputCol="_counts", outputCol=output).fit(counted)])


def fit_text(
    df: DataFrame, column: str, output: str = "text_vector", dimensions: int = TEXT_DIMENSIONS
) -> PipelineModel:
    """Hashed word counts weighted by inverse document frequency; only the weights are fitted."""
    counter = text_counts(column, dimensions)
    return PipelineModel([*counter.stages, *fit_count_weights(counter.transform(df.select(column)), output).stages])
