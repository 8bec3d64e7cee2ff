"""Scores of predictions against labels, all computed from a small table of counts."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetier.constants import ID, TARGET, TIER_NAMES, TIERS


def eval_join(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions with labels of the same id: (id, price_tier, true_tier, n).

    An inner join in which repeated ids multiply, as n; both sides are counted per id and tier
    first, so that an id with very many copies costs a handful of rows. Rows without a tier on
    either side can't be judged and take no part; `dropped_rows` counts them.
    """
    predictions, labels = predictions.where(F.col(TARGET).isNotNull()), labels.where(F.col(TARGET).isNotNull())
    predicted = predictions.groupBy(ID, TARGET).agg(F.count(F.lit(1)).alias("n_predicted"))
    actual = labels.groupBy(ID, F.col(TARGET).alias("true_tier")).agg(F.count(F.lit(1)).alias("n_actual"))
    return predicted.join(actual, ID).select(
        ID, TARGET, "true_tier", (F.col("n_predicted") * F.col("n_actual")).alias("n")
    )


def dropped_rows(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: predictions and labels that have no tier."""
    count = F.count_if(F.col(TARGET).isNull())
    return predictions.agg(count.alias("no_prediction")).join(labels.agg(count.alias("no_label")))


def confusion(
    df: DataFrame, *by: str, weight: Column | None = None, truth: str = "true_tier", predicted: str = TARGET
) -> DataFrame:
    """Rows per (true, predicted), within groups `by` if given; rows lacking either are left out."""
    df = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    return df.groupBy(*by, F.col(truth).cast("int").alias("t"), F.col(predicted).cast("int").alias("p")).agg(
        F.sum(F.lit(1) if weight is None else weight).cast("bigint").alias("n")
    )


def class_scores(counts: DataFrame, *by: str) -> DataFrame:
    """Precision, recall, F1 and support per class present in truth or prediction."""
    sides = counts.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("t").alias("tier"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("called")),
                F.struct(F.col("p").alias("tier"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("called")),
            )
        ),
        F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
    )
    # A hit appears once on each side, so its sum is halved.
    totals = sides.groupBy(*by, "tier").agg(
        F.sum("actual").alias("support"),
        F.sum("called").alias("called"),
        (F.sum("hit") / 2).cast("bigint").alias("hit"),
    )
    return totals.where(F.col("support") + F.col("called") > 0).withColumns(
        {
            "precision": _share("hit", F.col("called")),
            "recall": _share("hit", F.col("support")),
            "f1": _share("hit", (F.col("called") + F.col("support")) / 2),
        }
    )


def _share(part: str, whole: Column) -> Column:
    return F.coalesce(F.col(part) / F.nullif(whole, F.lit(0)), F.lit(0.0))


def macro_f1(counts: DataFrame, *by: str) -> DataFrame:
    """Unweighted mean F1 over the classes present in truth or prediction."""
    scores = class_scores(counts, *by)
    return (scores.groupBy(*by) if by else scores).agg(F.avg("f1").alias("macro_f1"))


MEASURES = ("precision", "recall", "f1", "support")
NO_MATCH = "No matching property_id between predictions and labels."


def _summary(counts: DataFrame) -> DataFrame:
    """Everything a report needs in one row: macro_f1, n_evaluated, and the seven report lines."""
    known = F.col("tier").isin(*TIERS)
    # At most four entries are gathered; other values only show in the averages.
    entry = F.struct("tier", *MEASURES, "called", "hit")
    one = class_scores(counts).agg(
        F.avg("f1").alias("macro_f1"),
        F.coalesce(F.sum("support"), F.lit(0)).alias("n_evaluated"),
        F.coalesce(F.max((~known).cast("int")), F.lit(0)).alias("others"),
        F.collect_list(F.when(known, entry)).alias("found"),
    )

    def entry_of(t: int) -> Column:
        return F.get(F.filter("found", lambda e: e["tier"] == t), F.lit(0))

    one = one.withColumns({f"tier{t}": entry_of(t) for t in TIERS})

    def of(t: int, measure: str) -> Column:
        zero = F.lit(0).cast("bigint") if measure in ("support", "called", "hit") else F.lit(0.0)
        return F.coalesce(F.col(f"tier{t}")[measure], zero)

    def total(measure: str) -> Column:
        return reduce(add, (of(t, measure) for t in TIERS))

    def mean(measure: str) -> Column:
        return total(measure) / len(TIERS)

    def weighted(measure: str) -> Column:
        parts = reduce(add, (of(t, measure) * of(t, "support") for t in TIERS))
        return F.coalesce(parts / F.nullif(total("support"), F.lit(0)), F.lit(0.0))

    def overall(whole: Column) -> Column:
        return F.coalesce(total("hit") / F.nullif(whole, F.lit(0)), F.lit(0.0))

    def line(position: int, name: Column, *values: Column) -> Column:
        return F.struct(
            F.lit(position).alias("position"), name.alias("name"), *[v.alias(m) for v, m in zip(values, MEASURES)]
        )

    support = total("support")
    name = F.when(F.col("others") == 1, "micro avg").otherwise("accuracy")
    pooled = overall(total("called")), overall(support), overall((total("called") + support) / 2)
    lines = [line(t, F.lit(TIER_NAMES[t]), *[of(t, m) for m in MEASURES]) for t in TIERS]
    lines.append(line(4, name, *pooled, support))
    lines.append(line(5, F.lit("macro avg"), *[mean(m) for m in MEASURES[:3]], support))
    lines.append(line(6, F.lit("weighted avg"), *[weighted(m) for m in MEASURES[:3]], support))
    return one.select("macro_f1", "n_evaluated", F.array(*lines).alias("lines"))


def class_report(counts: DataFrame) -> DataFrame:
    """(position, name, precision, recall, f1, support): the four tiers, then the averages.

    All four tiers are listed, with zeros where a tier is absent. The overall row is called
    accuracy when every value is one of the four tiers, else micro avg.
    """
    return _summary(counts).select(F.inline("lines"))


def _report_text(lines: Column) -> Column:
    """The seven lines as a text table with a heading."""
    head = f"{'':>12}  {'precision':>9} {'recall':>9} {'f1-score':>9} {'support':>9}\n\n"
    blank = F.lit("")

    def row(r: Column) -> Column:
        full = F.format_string("%12s  %9.2f %9.2f %9.2f %9d", r["name"], *[r[measure] for measure in MEASURES])
        short = F.format_string("%12s  %9s %9s %9.2f %9d", r["name"], blank, blank, r["f1"], r["support"])
        text = F.when(r["name"] == "accuracy", short).otherwise(full)
        return F.when(r["position"] == 4, F.concat(F.lit("\n"), text)).otherwise(text)

    return F.concat(F.lit(head), F.array_join(F.transform(lines, row), "\n"), F.lit("\n"))


def evaluation_record(counts: DataFrame) -> DataFrame:
    """One row: macro_f1 to four digits, n_evaluated, report, error.

    When no prediction met a label, only n_evaluated (0) and error are filled.
    """
    empty = F.col("n_evaluated") == 0
    return _summary(counts).select(
        F.when(~empty, F.round("macro_f1", 4)).alias("macro_f1"),
        "n_evaluated",
        F.when(~empty, _report_text(F.col("lines"))).alias("report"),
        F.when(empty, F.lit(NO_MATCH)).alias("error"),
    )


def no_id_record(labels: DataFrame) -> DataFrame:
    """The record for labels that cannot be matched because they carry no id."""
    error = [(None, 0, None, f"No {ID} column in the labels.")]
    return labels.sparkSession.createDataFrame(
        error, "macro_f1 double, n_evaluated bigint, report string, error string"
    )


def evaluate_tables(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Evaluation record of a predictions table against a labels table."""
    return evaluation_record(confusion(eval_join(predictions, labels), weight=F.col("n")))


def tier_distribution(predictions: DataFrame) -> DataFrame:
    """Predictions per tier, zero included, with the tier's name."""
    tiers = predictions.sparkSession.createDataFrame(list(zip(TIERS, TIER_NAMES)), f"{TARGET} int, tier_name string")
    counted = predictions.groupBy(F.col(TARGET).cast("int").alias(TARGET)).agg(F.count(F.lit(1)).alias("n"))
    return tiers.join(counted, TARGET, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def agreement_rate(df: DataFrame, left: str, right: str) -> DataFrame:
    """Share of rows in which two columns agree; a guard against leakage of the target."""
    return df.agg(F.avg((F.col(left) == F.col(right)).cast("int")).alias("agreement"))
