"""CSV and JSON in and out, and telling the data table from the labels table."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgetier.constants import ID, NA_TOKENS, TARGET
from lodgetier.functions.scalars import identifier
from lodgetier.operators.schema import plain_name, repair_names

# Without column pruning every row is parsed whole, so that a ragged one is seen whatever columns a query reads.
CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "enforceSchema": True, "columnPruning": False}

#: First lines of files read at a time.
HEADER_READERS = 32

#: Column for lines whose fields don't match their header.
RAGGED = "_ragged_line"


def null_na_tokens(df: DataFrame) -> DataFrame:
    """Null every string field that is exactly one of the texts standing for "missing"."""
    columns = [(f, F.col("`" + f.name.replace("`", "``") + "`")) for f in df.schema.fields]
    return df.select(
        *[
            F.when(~c.isin(*NA_TOKENS), c).alias(f.name) if isinstance(f.dataType, T.StringType) else c
            for f, c in columns
        ]
    )


def file_headers(spark: SparkSession, *paths: str) -> dict[tuple[str, ...], list[str]]:
    """Files of some paths (file, folder or pattern; a path that exists is no pattern) by their column names.

    Only headers are read, many files at a time, through the file system of the path; names come back as
    written. A header may hold quoted line breaks. Files without a header are listed under ().
    """
    jvm = spark._jvm
    settings = spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(settings)
    files, todo = [], []
    for place in map(jvm.org.apache.hadoop.fs.Path, paths):
        system = place.getFileSystem(settings)
        found = [system.getFileStatus(place)] if system.exists(place) else system.globStatus(place) or ()
        todo += [(system, status) for status in found]
    while todo:
        system, status = todo.pop()
        if status.getPath().getName().startswith(("_", ".")):
            continue
        if status.isDirectory():
            todo += [(system, inner) for inner in system.listStatus(status.getPath())]
        else:
            files.append((system, status.getPath()))

    def header(file) -> tuple[str, ...]:
        system, path = file
        stream = system.open(path)
        codec = codecs.getCodec(path)
        stream = codec.createInputStream(stream) if codec else stream
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        try:
            text = (line + "\n" for line in iter(lines.readLine, None))
            rows = (row for row in csv.reader(_without_mark(text)) if row)
            return tuple(next(rows, ()))
        finally:
            lines.close()

    groups: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        for (_, path), names in zip(files, pool.map(header, files)):
            groups.setdefault(names, []).append(path.toString())
    return groups


def _without_mark(lines: Iterator[str]) -> Iterator[str]:
    for i, line in enumerate(lines):
        yield line if i else line.removeprefix("\ufeff")


def literal_path(path: str) -> str:
    """A path with the characters of patterns escaped, since readers take every path for a pattern."""
    return re.sub(r"([\[\]{}*?\\,])", r"\\\1", path)


def text_schema(names: Sequence[str]) -> T.StructType:
    """Positions instead of names, since names may differ in case only, and a place for what doesn't fit."""
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    return T.StructType([*fields, T.StructField(RAGGED, T.StringType())])


def under_names(df: DataFrame, names: Sequence[str], ragged: str) -> DataFrame:
    """Columns read by position under their names; names equal but for case and blanks are one column.

    Of several values for one column the first present wins. Rows with more or fewer fields than the
    header are refused ("fail"), left out ("drop") or kept with their line in `RAGGED` ("keep").
    """
    if ragged not in ("fail", "drop", "keep"):
        raise ValueError(f"unknown treatment {ragged!r}")
    places: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        same = next((n for n in places if plain_name(n) == plain_name(name)), name)
        places.setdefault(same, []).append(i)
    clean = null_na_tokens(df)
    columns = [F.coalesce(*[F.col(f"c{i}") for i in at]).alias(name) for name, at in places.items()]
    # The line names a data column too, since by itself it can't be asked for.
    line = F.concat(F.col(RAGGED), F.coalesce(F.substring("c0", 1, 0), F.lit("")))
    if ragged == "keep":
        return clean.select(*columns, line.alias(RAGGED))
    if ragged == "drop":
        return clean.where(line.isNull()).select(*columns)
    message = F.concat(F.lit("row with another number of fields than the header: "), line)
    refused = F.when(line.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return clean.where(refused).select(*columns)


def read_listings(
    spark: SparkSession,
    path: str | Sequence[str],
    multi_line: bool = True,
    ragged: str = "fail",
    headers: dict[tuple[str, ...], list[str]] | None = None,
) -> DataFrame:
    """Every CSV column as text, with missing-value texts nulled; no inference pass.

    Each file is read by its own header, so files may differ in order and number of columns. Files with one
    header are read together under the names as written; with several headers, names are normalised and
    aliases resolved before the files are put together, and absent columns are null. A row with more or
    fewer fields than its header is refused, left out or kept by `ragged`, whatever columns are asked for.
    Files without a header, such as empty ones, hold no rows; `headers` are those of an earlier `file_headers`.

    Quoted line breaks need `multi_line`, which reads one file per task. Tables without line
    breaks inside fields should be read with multi_line=False, so that large files are split.
    """
    groups = file_headers(spark, *_listed(path)) if headers is None else headers
    tables = [under_names(rows, names, ragged) for names, rows in _parsed(spark, groups, multi_line)]
    if not tables:
        raise ValueError(f"no CSV file with a header under {path}")
    if len(tables) == 1:
        return tables[0]
    return reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), map(repair_names, tables))


def rejected_lines(
    spark: SparkSession,
    path: str | Sequence[str],
    multi_line: bool = True,
    headers: dict[tuple[str, ...], list[str]] | None = None,
) -> DataFrame:
    """(path, line, reason): what `read_listings` with ragged="drop" leaves out: ragged rows and files without a header."""
    groups = file_headers(spark, *_listed(path)) if headers is None else headers
    none = [(file, None, "no header") for file in groups.get((), ())]
    found = spark.createDataFrame(none, "path string, line string, reason string")
    for names, rows in _parsed(spark, groups, multi_line):
        reason = F.concat(F.lit(f"not {len(names)} fields"), F.coalesce(F.substring("c0", 1, 0), F.lit("")))
        lines = rows.select(F.col("_metadata.file_path").alias("path"), F.col(RAGGED).alias("line"), reason.alias("reason"))
        found = found.unionByName(lines.where("line is not null"))
    return found


def _listed(path: str | Sequence[str]) -> Sequence[str]:
    return [path] if isinstance(path, str) else path


def _parsed(spark: SparkSession, groups: dict[tuple[str, ...], list[str]], multi_line: bool) -> list[tuple[tuple[str, ...], DataFrame]]:
    """(names, rows by position) of the files of each header."""
    options = CSV_OPTIONS | {"multiLine": multi_line, "columnNameOfCorruptRecord": RAGGED}
    return [
        (names, spark.read.schema(text_schema(names)).options(**options).csv([literal_path(f) for f in sorted(found)]))
        for names, found in sorted(groups.items()) if names
    ]


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; blanks around values are kept."""
    df.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def predictions_table(df: DataFrame) -> DataFrame:
    """Id and tier, as whole numbers."""
    return df.select(identifier(F.col(ID)).alias(ID), F.col(TARGET).cast("int").alias(TARGET))


def write_predictions(df: DataFrame, path: str) -> None:
    write_csv(predictions_table(df), path)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object per row; nulls are kept as fields."""
    df.write.option("ignoreNullFields", False).json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def split_inputs(tables: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Tell data from labels by looking at column names only: (data, labels or None).

    The target column makes a table the labels. If two tables have it, or neither has, the wider
    one is the data, the first one on equal width.
    """
    if not 1 <= len(tables) <= 2:
        raise ValueError(f"expected one or two tables, got {len(tables)}")
    wider_first = sorted(tables, key=lambda t: -len(t.columns))
    labelled = [t for t in wider_first if TARGET in t.columns]
    unlabelled = [t for t in wider_first if TARGET not in t.columns]
    if not labelled:
        return wider_first[0], None
    data = unlabelled[0] if unlabelled else labelled[0].drop(TARGET)
    labels = labelled[-1]
    return data, labels.select(*[c for c in (ID, TARGET) if c in labels.columns])
