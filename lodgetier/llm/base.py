"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are no ASCII white space. `bytes.split()` cuts the same words.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text worked on at a time inside a task, so that memory doesn't follow the batch size.
SLICE_BYTES = 4 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that tasks can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent.parent
        held = Path(tempfile.mkdtemp(prefix="package-"))  # the driver's own copy, which Spark sends out
        spark.sparkContext.addPyFile(
            shutil.make_archive(str(held / package.name), "zip", package.parent, package.name)
        )
        _shipped.add(app)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """`mapInArrow` with this package at hand in the tasks, which give memory back when they end."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Returns freed memory to the system; a worker process serves many tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with all columns but `needed` under names that can't clash, and what gives the names back."""
    names = docs.columns
    plain = [n if n in needed else f"_column_{i}" for i, n in enumerate(names)]
    return docs.toDF(*plain), lambda out: out.select(*plain).toDF(*names)


def payload(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, a null as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def slices(texts: list, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts holding about `size` bytes together, at least one text each."""
    first, held = 0, 0
    for at, text in enumerate(texts):
        if held and held + len(text) > size:
            yield first, at
            first, held = at, 0
        held += len(text)
    if texts:
        yield first, len(texts)


def spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indexes starts[i], starts[i] + 1, ... of length lengths[i], one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a whole-number key, cut so that no group of equal keys is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))  # its last group may go on in the next batch
        if held and (last or held[-1].column(key)[0].as_py() != keys[0]):
            yield _one([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield batch.slice(0, last)
        held.append(batch.slice(last))
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(batches) if len(batches) > 1 else batches[0]


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id written as text; a null id as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))
