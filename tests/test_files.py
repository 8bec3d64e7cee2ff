"""Reading CSV files that are odd: ragged rows, names like patterns, empty files, line breaks in headers."""

import pytest
from pyspark.sql import functions as F

from lodgetier.plans import train
from lodgetier.sources import files
from lodgetier.streaming import score as streaming

BAD = 'id,name,lat\n1,a,2.0\n2,b\n3,c,4,5\n4,"x\ny",9\n'


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


@pytest.mark.parametrize("multi_line", [True, False])
def test_ragged_rows_are_refused_under_any_plan(spark, tmp_path, multi_line):
    path = put(tmp_path, "bad.csv", BAD.replace("x\ny", "xy"))
    rows = files.read_listings(spark, path, multi_line)
    for read in (rows.count, rows.select("lat").collect, rows.select("id").collect, rows.where("lat > '3'").count, lambda: rows.agg(F.max("name")).collect()):
        with pytest.raises(Exception, match="another number of fields"):
            read()


def test_ragged_rows_are_left_out_under_any_plan(spark, tmp_path):
    rows = files.read_listings(spark, put(tmp_path, "bad.csv", BAD), ragged="drop")
    assert rows.count() == 2 and [r.lat for r in rows.select("lat").collect()] == ["2.0", "9"]
    kept = files.read_listings(spark, put(tmp_path, "bad.csv", BAD), ragged="keep")
    assert kept.where(F.col(files.RAGGED).isNotNull()).select("id", files.RAGGED).count() == 2


def test_rejected_lines_say_where_and_why(spark, tmp_path):
    put(tmp_path, "bad.csv", BAD)
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "good.csv", "id,name\n7,q\n")
    found = {(r.path.rsplit("/", 1)[1], r.line, r.reason) for r in files.rejected_lines(spark, str(tmp_path)).collect()}
    assert found == {("bad.csv", "2,b", "not 3 fields"), ("bad.csv", "3,c,4,5", "not 3 fields"), ("empty.csv", None, "no header")}
    read = files.read_listings(spark, str(tmp_path), ragged="drop").count()
    assert read == 3  # of five rows two are rejected


def test_names_like_patterns(spark, tmp_path):
    for name in ("listings[1].csv", "a{b,c}.csv", "q?*.csv"):
        path = put(tmp_path, name, "id,name\n1,a\n")
        assert files.read_listings(spark, path).collect()[0].name == "a"
    assert files.read_listings(spark, str(tmp_path)).count() == 3
    assert files.read_listings(spark, str(tmp_path) + "/*.csv").count() == 3


def test_line_break_in_a_header(spark, tmp_path):
    path = put(tmp_path, "broken.csv", '﻿id,"long\nname",lat\n1,a,2\n3,"b\nc",4\n')
    rows = files.read_listings(spark, path)
    assert rows.columns == ["id", "long\nname", "lat"] and [r.lat for r in rows.collect()] == ["2", "4"]


def test_empty_files(spark, tmp_path):
    put(tmp_path, "empty.csv", "")
    with pytest.raises(ValueError, match="header"):
        files.read_listings(spark, str(tmp_path))
    put(tmp_path, "full.csv", "id,name\n1,a\n")
    assert files.read_listings(spark, str(tmp_path)).count() == 1


def test_a_stream_goes_on_after_odd_files(spark, tmp_path):
    rows = [(i, "a b", 40.0 + i / 100, -74.0, float(i % 4), "Manhattan", "X", "Private room", i % 4) for i in range(40)]
    schema = "property_id long, description string, latitude double, longitude double, number_of_reviews double, neighbourhood_group string, neighbourhood string, room_type string, price_tier int"
    columns = "minimum_nights calculated_host_listings_count availability_365".split()
    listings = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1.0) for c in columns})
    model = train.fit_tabular_model(listings, clusters=None, trees=2)
    arriving, out, bad = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "bad")
    arriving.mkdir()

    def run():
        stream = streaming.listing_files(spark, str(arriving), files_per_batch=1)
        streaming.score_stream(stream, model, out, str(tmp_path / "checkpoint"), rejected=bad, until_done=True).awaitTermination()

    put(arriving, "empty.csv", "")
    put(arriving, "blank.csv", "\n")
    run()
    put(arriving, "one.csv", "id,name,latitude,longitude\n1,a,40.1,-74\n2,b\n")
    run()
    assert [r.property_id for r in spark.read.parquet(out).collect()] == [1]
    found = spark.read.schema("path string, line string, reason string").parquet(bad)
    assert {(r.line, r.reason) for r in found.collect()} == {(None, "no header"), ("2,b", "not 4 fields")}
