"""Session, shared scratch folder, and joins that hold up when one key is hot."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is treated as hot from about this many rows on, judged from a sample. Only the largest
# HOT_KEYS keys are listed, so the list fits the driver and can be broadcast whatever the table
# size; any key beyond the list holds less than about 1/HOT_KEYS of the rows.
HOT_ROWS = 1_000_000
HOT_KEYS = 1_000
HOT_SAMPLE = 0.01

# A table counted to have at most this many rows may be broadcast.
BROADCAST_ROWS = 200_000


_scratch: dict[str, str] = {}


def session(app: str = "lodgetier", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the package expects; cluster settings are left alone."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's shared one, or a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if shared:
        return f"{shared.rstrip('/')}/lodgetier-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="lodgetier-")
    return _scratch[app]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application, so that Python tasks can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped or spark.sparkContext.master.startswith("local"):
        return
    package = Path(__file__).resolve().parent
    held = Path(tempfile.mkdtemp(prefix="package-"))  # the driver's own copy, which Spark sends out
    archive = shutil.make_archive(str(held / package.name), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the scratch folder and read it back.

    Cuts the lineage like a checkpoint, survives the loss of executors, and later readers
    still get column pruning and filter pushdown. `options` are those of the Parquet writer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys that hold very many rows, found in a sample; None if there are none.

    The list is fetched once, so that every use of it sees the same keys. Which keys are on it
    only matters for speed.
    """
    sample = rows.select(*keys).sample(HOT_SAMPLE, seed=7)
    found = (
        sample.groupBy(*keys)
        .count()
        .where(F.col("count") > hot_rows * HOT_SAMPLE)
        .orderBy(F.desc("count"))
        .limit(HOT_KEYS)
        .select(*keys)
    )
    listed = found.collect()
    return rows.sparkSession.createDataFrame(listed, found.schema) if listed else None


def spread_join(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join many rows to a table with few rows per key, without one task per hot key.

    Without hot keys this is an ordinary join. Otherwise rows of hot keys meet a broadcast of just
    those keys' table rows and are never shuffled. `table` must hold a bounded number of rows per
    key; `how` is "inner" or "left".
    """
    hot = hot_keys(rows, keys, hot_rows)
    if hot is None:
        return rows.join(table, keys, how)
    hot = F.broadcast(hot)
    keyed = rows.dropna(subset=keys)
    usual = keyed.join(hot, keys, "left_anti").join(table, keys, how)
    hot_table = F.broadcast(table.join(hot, keys, "left_semi"))
    heavy = keyed.join(hot, keys, "left_semi").join(hot_table, keys, how)
    joined = usual.unionByName(heavy)
    if how == "left":
        # A row without a key matches nothing, so it needs no shuffle either.
        keyless = rows.where(reduce(or_, (F.col(key).isNull() for key in keys)))
        joined = joined.unionByName(keyless, allowMissingColumns=True)
    return joined


def small_or_spread_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Broadcast `table` when it was counted to be small, else join it by key."""
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, how)
    return spread_join(rows, table, keys, how)
