"""Scoring of listing files as they arrive: the batch preparation and scoring, file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodgetier.plans.batch import prepare, score_batch
from lodgetier.plans.train import TierModel
from lodgetier.sources.files import file_headers, predictions_table, read_listings, rejected_lines


def listing_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Paths of CSV files put into a folder; their content is not read here."""
    fields = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.schema(fields).format("binaryFile").option("maxFilesPerTrigger", files_per_batch)
    return stream.load(folder).select("path")


def score_stream(
    arriving: DataFrame,
    tabular: TierModel,
    output: str,
    checkpoint: str,
    text: TierModel | None = None,
    external: DataFrame | None = None,
    multi_line: bool = True,
    ragged: str = "fail",
    rejected: str | None = None,
    until_done: bool = False,
    **preparation,
) -> StreamingQuery:
    """Write (id, price_tier) for every row of arriving files, exactly once, as parquet under `output`.

    Each file is read by its own header and prepared as in batch; `preparation` takes the same mapping and
    static tables of translations and inferences. A batch goes to a folder of its own, which a repeated
    attempt replaces, and the checkpoint makes a restarted query go on where it stopped. With until_done,
    the query stops after the files present at the start.

    With a folder `rejected`, rows that don't fit their header and files without one don't stop the query: they
    are written there as (path, line, reason), batch by batch like the predictions.
    """

    def score(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.collect()]  # at most files_per_batch
        spark = batch.sparkSession
        headers = file_headers(spark, *paths) if paths else {}
        if rejected and paths:
            lines = rejected_lines(spark, paths, multi_line, headers)
            lines.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        if any(headers):  # a batch of empty files has no rows
            treatment = "drop" if rejected else ragged
            rows = prepare(read_listings(spark, paths, multi_line, treatment, headers), **preparation)
            scored = predictions_table(score_batch(rows, tabular, text, external))
            scored.write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = arriving.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    if until_done:
        writer = writer.trigger(availableNow=True)
    return writer.start()
