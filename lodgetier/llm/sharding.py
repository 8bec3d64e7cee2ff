"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to source partitions by a hash of their id. How many rows each partition sends to each
target block is drawn beforehand, exactly as a uniform permutation of all rows would have it: a matrix
with the partition sizes as row sums and the block sizes as column sums, each entry hypergeometric given
those before. Every partition permutes its rows and cuts them at its row of the matrix, rows move to their
block, and each block permutes again. A shard is a run of blocks, so its slots are known without a task
that sees the whole shard. Everything per row is a column expression.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows meant for one local permutation, and the most partitions or blocks (bounds the matrix on the driver).
ROWS_PER_BLOCK = 200_000
MOST_BLOCKS = 1_024


def hypergeometric(rng: np.random.Generator, good: int, total: int, draws: int) -> int:
    """Good items among `draws` of `total` without replacement, by inversion around the mode at any size."""
    low, high = max(0, draws - (total - good)), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    share = good / total
    spread = (draws * share * (1 - share) * (total - draws) / max(1, total - 1)) ** 0.5
    reach = int(12 * spread) + 20
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rise = np.cumprod((good - up) * (draws - up) / ((up + 1) * (total - good - draws + up + 1)))
    fall = np.cumprod(down * (total - good - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weight = np.concatenate([fall[::-1], [1.0], rise])
    ends = np.cumsum(weight)
    return mode - len(fall) + int(np.searchsorted(ends, rng.random() * ends[-1], side="right"))


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """Counts with the given row and column sums, distributed as under a uniform permutation."""
    rng = np.random.default_rng(seed)
    left = [int(c) for c in columns]
    matrix = np.zeros((len(rows), len(columns)), dtype=np.int64)
    for i, draws in enumerate(rows):
        rest, draws = sum(left), int(draws)
        for j, capacity in enumerate(left):
            got = hypergeometric(rng, capacity, rest, draws)
            matrix[i, j] = got
            rest -= capacity
            draws -= got
        left = [c - int(g) for c, g in zip(left, matrix[i])]
    return matrix


def block_sizes(n: int, shards: int, blocks: int) -> list[list[int]]:
    """Sizes of each shard's blocks: shards differ by one row at most, and so do the blocks of a shard."""
    shard = [n // shards + (s < n % shards) for s in range(shards)]
    return [[m // blocks + (b < m % blocks) for b in range(blocks)] for m in shard]


def shuffle_into_shards(
    rows: DataFrame, shards: int = 8, keys: tuple[str, ...] = ("doc_id",), seed: int = 42,
    rows_per_block: int = ROWS_PER_BLOCK, most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """`rows` with `shard` (0 to shards - 1) and `slot` (gapless from 0 in its shard), uniformly shuffled.

    Shards differ by one row at most, whatever the keys or texts. Null keys count as a value. Rows with the
    same keys share a partition before the exchange and are dealt like any others; which of two equal rows
    gets which place is open. Input columns named shard or slot are replaced. An empty table stays empty.
    The same rows and seed give the same places, however the input is split into files or tasks.
    """
    rows = rows.drop("shard", "slot")
    hashed = [F.hash(F.lit(seed), *keys).cast("long"), *keys]
    n = rows.count()
    parts = min(most_blocks, max(shards, -(-n // rows_per_block)))
    blocks = min(max(1, most_blocks // shards), max(1, -(-n // (shards * rows_per_block))))
    part = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(parts)).cast("int")
    counted = rows.select(part.alias("p")).groupBy("p").count().collect()  # one row per partition
    held = {r["p"]: r["count"] for r in counted}
    sizes = block_sizes(n, shards, blocks)
    flat = [size for shard in sizes for size in shard]
    matrix = communication_matrix([held.get(p, 0) for p in range(parts)], flat, seed)
    ends = json.dumps(np.cumsum(matrix, axis=1).tolist())
    first = json.dumps([sum(shard[:b]) for shard in sizes for b in range(blocks)])
    plan = rows.sparkSession.range(1).select(
        F.posexplode(F.from_json(F.lit(ends), "array<array<bigint>>")).alias("_part", "_ends")
    )
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed + 1), *keys), *hashed)
    sent = (
        rows.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(local).cast("long"))
        .join(F.broadcast(plan), "_part")
        .withColumn("_block", F.expr("size(filter(_ends, e -> e < _rank))"))
        .drop("_ends", "_rank", "_part")
    )
    again = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 2), *keys), *hashed)
    base = F.element_at(F.from_json(F.lit(first), "array<bigint>"), F.col("_block") + 1)
    return (
        sent.withColumn("slot", base + F.row_number().over(again) - 1)
        .withColumn("shard", F.floor(F.col("_block") / F.lit(blocks)).cast("int"))
        .drop("_block")
    )


def shard_table(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """One row per document with its size, checksum, shard and slot; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = shuffle_into_shards(sized, shards, ("doc_id",), seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
