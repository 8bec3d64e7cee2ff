"""Exact, repeatable splits and samples that never sort or gather the whole table.

Rows are ordered by a seeded hash of their id. Where an exact number of rows has to fall on one
side, the boundary is found by counting: first rows per hash prefix (at most 65,536 counts per
class), then rows per hash inside the one prefix the boundary lies in. The split itself is then
a plain filter. Rows that share an id are told apart by a hash of the whole row, and full copies
are counted and shared out by number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgetier.constants import FOLDS, ID, SEED, SHOTS_PER_TIER, TARGET, VALIDATION_SHARE
from lodgetier.functions.scalars import row_hash
from lodgetier.runtime import materialise

PREFIX_BITS = 16
COPIES_PER_CHUNK = 100_000
MAX_CLASSES = 10_000

Counts = dict[str | None, int]  # per class, as text
Bounds = dict[str | None, list[int]]


def class_counts(df: DataFrame, column: str) -> Counts:
    """Rows per class, keyed by the class as text. For columns with few values only."""
    rows = df.groupBy(F.col(column).cast("string").alias("c")).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{column} has more than {MAX_CLASSES} values, so it is no class column")
    return {r["c"]: r["count"] for r in rows}


def stratified_split(
    df: DataFrame, share: float = VALIDATION_SHARE, by: str = TARGET, key: str = ID, seed: int = SEED
) -> DataFrame:
    """Add is_validation: ceil(share * n) rows, each class in proportion by largest remainder."""

    def bounds(counts: Counts) -> Bounds:
        quotas = proportional_quotas(counts, ceil(round(share * sum(counts.values()), 6)))
        return {c: [quota] for c, quota in quotas.items()}

    split = _assign(df, by, key, seed, bounds)
    return split.withColumn("is_validation", F.col("part") == 0).drop("part")


def proportional_quotas(counts: Counts, wanted: int) -> Counts:
    """Whole numbers that add up to `wanted` and differ by less than one from exact proportion."""
    total = sum(counts.values())
    exact = {c: wanted * n / total for c, n in counts.items()} if total else {}
    quotas = {c: floor(x) for c, x in exact.items()}
    by_remainder = sorted(exact, key=lambda c: (quotas[c] - exact[c], str(c)))
    for c in by_remainder[: wanted - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def per_class_sample(
    df: DataFrame, k: int = SHOTS_PER_TIER, by: str = TARGET, key: str = ID, seed: int = SEED
) -> DataFrame:
    """k rows of every class, or all of them where a class has fewer; null is no class."""
    df = df.where(F.col(by).isNotNull())
    return _assign(df, by, key, seed, lambda counts: {c: [k] for c in counts}).where("part = 0").drop("part")


def kfold(df: DataFrame, k: int = FOLDS, key: str = ID, seed: int = SEED) -> DataFrame:
    """Add fold 0..k-1; sizes differ by one row at most."""

    def bounds(counts: Counts) -> Bounds:
        size, larger = divmod(sum(counts.values()), k)
        return {"": [size * (i + 1) + min(i + 1, larger) for i in range(k - 1)]}

    return _assign(df, None, key, seed, bounds).withColumnRenamed("part", "fold")


def subset_n(df: DataFrame, n: int, key: str = ID, seed: int = SEED) -> DataFrame:
    """n rows, uniformly."""
    return _assign(df, None, key, seed, lambda counts: {"": [n]}).where("part = 0").drop("part")


def _assign(df: DataFrame, by: str | None, key: str, seed: int, bounds_of: Callable[[Counts], Bounds]) -> DataFrame:
    """Add part: how many of its class's bounds (cumulative row counts) a row lies behind."""
    columns = df.columns
    group = F.col(by).cast("string") if by else F.lit("")
    rows = df.select(
        "*",
        group.alias("_group"),
        F.coalesce(row_hash(F.col(key), seed), F.lit(0)).alias("_hash"),
        F.shiftrightunsigned(F.xxhash64(*columns), 4).alias("_row"),
    )
    # One pass gives both the class sizes and where in each class a bound roughly lies.
    by_prefix = materialise(_count_prefixes(rows, "_hash"), "prefixes")
    sizes = by_prefix.groupBy("_group").agg(F.sum("count").alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"{by} has more than {MAX_CLASSES} values, so it is no class column")
    bounds = bounds_of({r["_group"]: r["n"] for r in sizes})
    return _settle(rows, columns, ["_hash", "_row"], bounds, by_prefix).select(*columns, "part")


def _prefix(order: str) -> Column:
    return F.shiftright(F.col(order), 60 - PREFIX_BITS)


def _count_prefixes(rows: DataFrame, order: str) -> DataFrame:
    return rows.groupBy("_group", _prefix(order).alias("_at")).count()


def _settle(
    rows: DataFrame, columns: list[str], orders: list[str], bounds: Bounds, by_prefix: DataFrame | None = None
) -> DataFrame:
    order = orders[0]
    cuts = _cuts(rows, order, bounds, by_prefix)
    part, torn = F.lit(0), F.lit(False)
    inner: Bounds = {}
    for group, wanted in bounds.items():
        here = F.col("_group").eqNullSafe(F.lit(group))
        behind = F.lit(0)
        for bound in wanted:
            if bound <= 0:
                behind = behind + 1
            elif (group, bound) in cuts:
                value, before, at = cuts[group, bound]
                behind = behind + (F.col(order) > value).cast("int")
                if before + at > bound:
                    torn = torn | (here & (F.col(order) == value))
                    inner[f"{group}:{value}"] = [max(0, min(at, b - before)) for b in wanted]
        part = F.when(here, behind).otherwise(part)
    if not inner:
        return rows.withColumn("part", part)
    settled = rows.where(~torn).withColumn("part", part)
    torn_group = F.concat(F.coalesce("_group", F.lit("None")), F.lit(":"), F.col(order).cast("string"))
    rest = rows.where(torn).withColumn("_group", torn_group)
    finer = _settle(rest, columns, orders[1:], inner) if orders[1:] else _share_copies(rest, columns, inner)
    return settled.unionByName(finer)


def _cuts(
    rows: DataFrame, order: str, bounds: Bounds, by_prefix: DataFrame | None
) -> dict[tuple[str | None, int], tuple[int, int, int]]:
    """For every bound, the order value it falls on, rows before that value, and rows on it."""
    spark = rows.sparkSession
    wanted = [(g, b, b) for g, bs in bounds.items() for b in bs if b > 0]
    if not wanted:
        return {}
    prefix = _prefix(order)
    coarse = _positions(by_prefix or _count_prefixes(rows, order), wanted)
    wanted = [(r["_group"], r["bound"], r["left"], r["_at"]) for r in coarse]
    if not wanted:
        return {}
    chosen = spark.createDataFrame(
        list({(g, at) for g, _, _, at in wanted}), "_group string, _prefix bigint"
    )
    inside = rows.withColumn("_prefix", prefix).join(
        F.broadcast(chosen.withColumnRenamed("_group", "_g")),
        (F.col("_g").eqNullSafe(F.col("_group"))) & (prefix == chosen["_prefix"]),
        "left_semi",
    )
    fine = _positions(
        inside.groupBy("_group", "_prefix", F.col(order).alias("_at")).count(),
        [(g, b, left, at) for g, b, left, at in wanted],
    )
    earlier = {(g, b): b - left for g, b, left, _ in wanted}
    return {
        (r["_group"], r["bound"]): (
            r["_at"],
            earlier[r["_group"], r["bound"]] + r["before"],
            r["count"],
        )
        for r in fine
    }


def _positions(counts: DataFrame, wanted: Sequence[tuple]) -> list:
    """Walk cumulative counts to the value each wanted position falls on; one row per bound."""
    keys = ["_group", "_prefix"] if "_prefix" in counts.columns else ["_group"]
    fields = "_g string, bound bigint, position bigint" + (", _p bigint" if len(keys) == 2 else "")
    positions = counts.sparkSession.createDataFrame(list(wanted), fields)
    running = counts.withColumn("upto", F.sum("count").over(Window.partitionBy(*keys).orderBy("_at")))
    match = F.col("_g").eqNullSafe(F.col("_group"))
    if len(keys) == 2:
        match = match & (F.col("_p") == F.col("_prefix"))
    before = F.col("upto") - F.col("count")
    return (
        running.join(F.broadcast(positions), match)
        .where((F.col("position") <= F.col("upto")) & (F.col("position") > before))
        .select("_group", "_at", "bound", "count", before.alias("before"), (F.col("position") - before).alias("left"))
        .collect()
    )


def _share_copies(rows: DataFrame, columns: list[str], bounds: Bounds) -> DataFrame:
    """Share out rows that are equal in every column, by counting them.

    Copies are counted with partial aggregation and written out again in chunks that are spread
    over the cluster, so no task handles all copies of a row.
    """
    same = [*columns, "_group", "_hash", "_row"]
    counted = rows.groupBy(*same).count()
    order = Window.partitionBy("_group").orderBy(F.to_json(F.struct(*columns)))
    counted = counted.withColumn("upto", F.sum("count").over(order))
    shares = None
    for group, wanted in bounds.items():
        edges = [0, *wanted, None]
        overlaps = []
        for part in range(len(wanted) + 1):
            low = F.greatest(F.lit(edges[part]), F.col("upto") - F.col("count"))
            high = F.col("upto") if edges[part + 1] is None else F.least(F.lit(edges[part + 1]), F.col("upto"))
            overlaps.append(F.struct(F.lit(part).alias("part"), (high - low).cast("bigint").alias("n")))
        here = F.col("_group").eqNullSafe(F.lit(group))
        shares = F.when(here, F.array(*overlaps)) if shares is None else shares.when(here, F.array(*overlaps))
    chunks = counted.select(*same, F.inline(shares)).where("n > 0").select(
        *same,
        "part",
        "n",
        F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / COPIES_PER_CHUNK).cast("bigint"))).alias("chunk"),
    )
    size = F.least(F.lit(COPIES_PER_CHUNK), F.col("n") - F.col("chunk") * COPIES_PER_CHUNK)
    return (
        chunks.repartition(F.col("_row"), F.col("part"), F.col("chunk"))
        .select(*same, "part", F.explode(F.array_repeat(F.lit(0), size.cast("int"))).alias("copy"))
        .drop("copy")
    )
