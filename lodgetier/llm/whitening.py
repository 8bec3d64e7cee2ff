"""Whitening of embeddings by weighted multiplicity covariance.

Entries are turned into whole numbers x; identical x vectors form a group with a count. Everything that is
fitted reads the groups: sums per dimension, then a centred product with the counts (or ones) as weights,
added up over tasks. The driver solves the eigenproblem of the one matrix, whose size is the dimension squared
whatever the number of rows. Each group is whitened once, and rows get their group's values by joining back.

Groups that hold more than a thousandth of the rows are fewer than a thousand; rows join these from a
broadcast, all others by key, so that no task gets the rows of a hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetier.llm.base import map_batches
from lodgetier.runtime import materialise

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32

#: A group with more than 1/HOT of the rows is joined by broadcast; there are fewer than HOT.
HOT = 1_000

#: Components whose variance is below this share of the largest, times the dimension, are rounding errors.
NO_VARIANCE = np.finfo(float).eps

#: Whole numbers are held below this size, so that their differences fit 64 bits.
LARGEST = float(1 << 60)


def whole_vectors(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): the rows that take part, entries as whole numbers.

    Null and empty vectors, vectors with null or non-finite entries, and those of another length than the
    commonest (the longer of two) take no part.
    """
    entry = F.col("embedding").cast("array<double>")
    sound = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound)
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    bound = F.lit(LARGEST)
    x = F.transform(entry, lambda c: F.greatest(F.least(F.floor(c * scale).cast("double"), bound), -bound).cast("long") + shift)
    kept = rows.where(F.size("embedding") == (sizes["size"] if sizes else -1))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def groups(rows: DataFrame) -> DataFrame:
    """(x, weight): distinct vectors and their number of rows, counted before they are moved."""
    return rows.groupBy("x").agg(F.count("*").alias("weight"))


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _sums(found: DataFrame) -> tuple[int, list[int]]:
    """Total weight and exact weighted sums of each dimension, as two halves of 32 bits that can't overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x, weight = _matrix(batch.column("x")), batch.column("weight").to_numpy()
                total += int(weight.sum())
                high, low = high + weight @ (x >> 32), low + weight @ (x & 0xFFFFFFFF)
        if total:
            yield pa.RecordBatch.from_pydict(
                {"dim": np.arange(-1, len(high)), "high": np.append(0, high), "low": np.append(total, low)}
            )

    parts = map_batches(found.select("x", "weight"), run, "dim long, high long, low long")
    summed = parts.groupBy("dim").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    rows = sorted(summed.collect())  # one per dimension
    if not rows:
        return 0, []
    return int(rows[0]["low"]), [(int(r["high"]) << 32) + int(r["low"]) for r in rows[1:]]


def _product(found: DataFrame, column: str, centre: np.ndarray, exact: tuple[int, list[int]] | None = None) -> np.ndarray:
    """Weighted product of centred vectors with themselves; `exact` (n, sums) centres whole numbers before rounding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centre), len(centre)))
        for batch in batches:
            if batch.num_rows:
                away = centred(_matrix(batch.column(column)), *exact) if exact else _matrix(batch.column(column), float) - centre
                total += (away * batch.column("weight").to_numpy()[:, None]).T @ away
        yield pa.RecordBatch.from_pydict({"dim": np.arange(len(total)), "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = map_batches(found.select(column, "weight"), run, "dim long, row array<double>")
    cells = parts.select("dim", F.posexplode("row").alias("other", "v")).groupBy("dim", "other").agg(F.sum("v").alias("v"))
    out = np.zeros((len(centre), len(centre)))
    for row in cells.collect():  # the dimension squared
        out[row["dim"], row["other"]] = row["v"]
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x minus the mean, rounded once: whole quotients are taken off before the fraction of the mean is."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    fraction = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - fraction


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n x - S) squared; None beyond 64 bits."""
    top = max(max(abs(int(a)), abs(int(b))) for a, b in zip(x.min(axis=0), x.max(axis=0)))
    if n * top + max(map(abs, sums)) < 3_000_000_000 // max(1, int(np.sqrt(x.shape[1])) + 1):
        away = n * x - np.array(sums, dtype=np.int64)
        return (away * away).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


class Whitening:
    """Mean, components and variances of the fit list."""

    def __init__(self, found: DataFrame, weights: str = "counts"):
        """`found` are groups; weights: "counts" fits on all rows, "one" on distinct vectors."""
        if weights not in ("counts", "one"):
            raise ValueError(f"unknown weights {weights!r}")
        self.fit_list = found if weights == "counts" else found.withColumn("weight", F.lit(1).cast("long"))
        self.n, self.sums = _sums(self.fit_list)
        self.covariance = np.zeros((0, 0))
        if self.n:
            self.covariance = _product(self.fit_list, "x", np.zeros(len(self.sums)), (self.n, self.sums)) / self.n
        values, vectors = np.linalg.eigh((self.covariance + self.covariance.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        kept = values > NO_VARIANCE * len(values) * (values[0] if len(values) else 0.0)
        self.values, self.vectors = values[kept], vectors[:, kept]

    def transform(self, found: DataFrame, components: int = COMPONENTS) -> DataFrame:
        """Groups with `deviation` and the list `whitened` of at most `components` values."""
        n, sums = self.n, self.sums
        turn = self.vectors[:, :components] / np.sqrt(self.values[:components])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("x"))
                    white = pa.array(list(centred(x, n, sums) @ turn), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(deviations(x, n, sums), pa.int64()), white], [*batch.schema.names, "deviation", "whitened"]
                    )

        return map_batches(found.select("x", "weight"), run, "x array<long>, weight long, deviation long, whitened array<double>")


def joined_back(rows: DataFrame, white: DataFrame, n_rows: int) -> DataFrame:
    """Rows with the values of their group."""
    hot = F.broadcast(white.where(F.col("weight") * HOT > n_rows).drop("weight"))  # fewer than HOT groups
    usual = white.where(F.col("weight") * HOT <= n_rows).drop("weight")
    met = rows.join(hot, "x", "left")
    others = met.where("whitened is null").select(rows.columns).join(usual.hint("merge"), "x")
    return met.where("whitened is not null").unionByName(others)


def whitened_table(vectors: DataFrame, components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that takes part.

    Which rows take part is said at `whole_vectors`. Components without variance are left out, so a single
    vector, or copies of one, give no rows. Repeated rows are returned each, a null vec_id is passed on.
    Entries beyond 2^60 / 64 count as that; a deviation beyond 64 bits is null. Columns but vec_id and embedding
    are not read. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = materialise(whole_vectors(vectors), "whole-vectors")
    found = materialise(groups(rows), "groups")
    model = Whitening(found, weights)
    kept = min(components, len(model.values))
    if not kept:
        return spark.createDataFrame([], _TABLE)
    white = materialise(model.transform(found, components), "whitened")
    fitted = white if weights == "counts" else white.withColumn("weight", F.lit(1).cast("long"))
    means = fitted.select("weight", F.posexplode("whitened").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v") * F.col("weight")).alias("s"))
    centre = np.zeros(kept)
    for row in means.collect():  # one per component
        centre[row["k"]] = row["s"] / model.n
    error = float(np.abs(_product(fitted, "whitened", centre) / model.n - np.eye(kept)).max())
    shares = (model.values[:kept] / np.trace(model.covariance)).tolist()
    total = found.agg(F.sum("weight")).first()[0]
    listed = joined_back(rows, white, total).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return listed.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, shares)), F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


_TABLE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
