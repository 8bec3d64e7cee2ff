"""Rows without a match and files of a large table do not meet in one task."""

from pyspark.sql import functions as F

from lodgetier import queries
from lodgetier.operators import missing


def test_rows_in_no_need_of_translation_are_dealt_to_all_tasks(spark):
    rows = spark.range(4_000).select(
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("property_id"),
        F.when(F.col("id") % 10 == 0, "Уютная студия").otherwise(F.concat(F.lit("flat "), "id")).alias("description"),
    )
    translated = spark.range(0, 4_000, 20).select(F.col("id").alias("property_id"), F.lit("Cozy").alias("translated"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, value in zip(kept, ("false", "-1")):  # as in a stream, on tables too large to broadcast
            spark.conf.set(c, value)
        found = missing.apply_translations(rows, translated).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)
    assert len(found) == 4_000
    assert {r.property_id for r in found if r.description == "Cozy"} == {i for i in range(0, 4_000, 20) if i % 7}
    sizes = [sum(r.task == t for r in found) for t in {r.task for r in found}]
    assert max(sizes) < 2 * 4_000 / 8


def test_mixed_headers_are_read_from_many_files(spark, sf, monkeypatch):
    whole = queries.queries()["read_mixed_headers"](spark, sf)
    monkeypatch.setattr(queries, "FILE_ROWS", 400, raising=False)
    parts = queries.queries()["read_mixed_headers"](spark, sf)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert len(parts.inputFiles()) >= 3 * 4
