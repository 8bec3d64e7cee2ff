"""Schema repair, role detection, gaps."""

import pytest
from pyspark.sql import functions as F

from lodgetier.constants import CANONICAL
from lodgetier.operators import missing, schema
from lodgetier.sources import files


def test_aliases_merge_in_order(spark):
    df = spark.createDataFrame([("7", "a", None, "b"), ("8", None, "t", "n")], "id string, summary string, title string, name string")
    assert [r.description for r in schema.repair_names(df).collect()] == ["b", "n"]
    df = spark.createDataFrame([(None, "t", "s")], "name string, title string, summary string")
    assert schema.repair_names(df).first().description == "t"


def test_canonical_name_wins_over_alias(spark):
    df = spark.createDataFrame([("borough", "group")], "borough string, neighbourhood_group string")
    assert schema.repair_names(df).first().asDict() == {"neighbourhood_group": "group"}


def test_mapping_ignores_unknown_targets(spark):
    df = spark.createDataFrame([("1", "x", "y")], "id string, what string, ever string")
    repaired = schema.repair_names(df, {"what": "room_type", "ever": "nothing"})
    assert repaired.first().asDict() == {"property_id": "1", "room_type": "x", "ever": "y"}


def test_names_are_normalised(spark):
    df = spark.createDataFrame([("1", "2", "z")], "` ID ` string, `Min Nights` string, `Odd Name` string")
    assert sorted(schema.repair_names(df).columns) == ["minimum_nights", "odd_name", "property_id"]


def test_sparse_table_is_completed(spark):
    df = spark.createDataFrame([("5", None, "41.5", "bad")], "id string, name string, lat string, lon string")
    row = schema.clean_listings(df).first()
    assert set(CANONICAL) <= set(row.asDict())
    assert (row.property_id, row.description, row.latitude, row.longitude) == (5, "", 41.5, -74.006)
    assert (row.minimum_nights, row.availability_365, row.neighbourhood_group) == (1.0, 180.0, "Manhattan")


def test_id_is_required(spark):
    with pytest.raises(ValueError):
        schema.clean_listings(spark.createDataFrame([("x",)], "name string"))


def test_nan_becomes_default(spark):
    df = spark.createDataFrame([(1, float("nan"))], "id int, lat double")
    assert schema.clean_listings(df).first().latitude == 40.7128


def test_cleaning_is_one_projection(spark, sf):
    from lodgetier.fixtures import raw_listings

    plan = schema.clean_listings(raw_listings(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def frame(spark, columns, rows=1):
    return spark.range(rows).select(*[F.lit(i).alias(c) for i, c in enumerate(columns.split())])


def test_roles(spark):
    plain, combined = frame(spark, "property_id a b"), frame(spark, "property_id a b price_tier")
    labels = frame(spark, "property_id price_tier")
    data, found = files.split_inputs([plain])
    assert data.columns == ["property_id", "a", "b"] and found is None
    data, found = files.split_inputs([combined])
    assert data.columns == ["property_id", "a", "b"] and found.columns == ["property_id", "price_tier"]
    data, found = files.split_inputs([frame(spark, "a price_tier")])
    assert data.columns == ["a"] and found.columns == ["price_tier"]
    for pair in ([plain, labels], [labels, plain]):
        data, found = files.split_inputs(pair)
        assert data.columns == plain.columns and found.columns == labels.columns
    for pair in ([combined, labels], [labels, combined]):
        data, found = files.split_inputs(pair)
        assert data.columns == ["property_id", "a", "b"] and found.columns == labels.columns
    data, found = files.split_inputs([frame(spark, "property_id"), combined])
    assert data.columns == ["property_id"], "a table without target is data even if it is narrower"
    data, found = files.split_inputs([frame(spark, "x y"), frame(spark, "p q")])
    assert data.columns == ["x", "y"] and found is None
    first, second = frame(spark, "property_id u price_tier"), frame(spark, "property_id v price_tier")
    data, found = files.split_inputs([first, second])
    assert data.columns == ["property_id", "u"] and found.columns == ["property_id", "price_tier"]
    data, found = files.split_inputs([frame(spark, "property_id PRICE_TIER")])
    assert found is None, "the target is matched as written"
    for wrong in ([], [plain, plain, plain]):
        with pytest.raises(ValueError):
            files.split_inputs(wrong)


def test_na_tokens_are_exact(spark):
    df = spark.createDataFrame([("NA",), (" NA ",), ("-",), ("",), ("nan",), ("x",)], "v string")
    assert [r.v for r in files.null_na_tokens(df).collect()] == [None, " NA ", "-", None, None, "x"]


def test_odd_column_names(spark):
    df = spark.createDataFrame([("NA", "x", "nan")], "`a.b` string, id string, `c``d` string")
    assert files.null_na_tokens(df).first().asDict() == {"a.b": None, "id": "x", "c`d": None}
    assert schema.repair_names(df).columns == ["property_id", "a.b", "c`d"]


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"two\nlines, and ""quotes"""\n2,\n')
    rows = files.read_listings(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.name for r in rows] == ['two\nlines, and "quotes"', None]


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,lat,lng\n1,one,40.1,-73.1\n")
    (tmp_path / "b.csv").write_text("lat,lng,id,name\n40.2,-73.2,2,two\n")
    (tmp_path / "c.csv").write_text("Property ID,lng\n3,NA\n")
    rows = {r.property_id: r for r in schema.repair_names(files.read_listings(spark, str(tmp_path))).collect()}
    assert (rows["1"].description, rows["1"].latitude) == ("one", "40.1")
    assert (rows["2"].description, rows["2"].latitude, rows["2"].longitude) == ("two", "40.2", "-73.2")
    assert rows["3"].description is None and rows["3"].longitude is None


def test_names_that_differ_in_case_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffid,Name,name,lat\n1,one,,40.1\n2,,two,40.2\n')
    rows = files.read_listings(spark, str(tmp_path))
    assert [r.description for r in schema.repair_names(rows).orderBy("property_id").collect()] == ["one", "two"]


@pytest.mark.parametrize("line", ["2,two,three", "2"])
def test_rows_that_do_not_fit_their_header(spark, tmp_path, line):
    (tmp_path / "a.csv").write_text(f"id,name\n1,one\n{line}\n")
    with pytest.raises(Exception, match="another number of fields"):
        files.read_listings(spark, str(tmp_path)).collect()
    assert [r.id for r in files.read_listings(spark, str(tmp_path), ragged="drop").collect()] == ["1"]
    kept = files.read_listings(spark, str(tmp_path), ragged="keep")
    assert sorted(str(r[files.RAGGED]) for r in kept.collect()) == [line, "None"]


def test_records_keep_nulls_and_types(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0.5), (2, "ü\n", None)], "property_id long, description string, x double")
    files.write_records(df, str(tmp_path / "r"))
    assert sorted(files.read_records(spark, str(tmp_path / "r"), df.schema).collect()) == sorted(df.collect())


def test_inference_before_or_after_defaults(spark):
    from lodgetier.plans.batch import prepare

    df = spark.createDataFrame([("1", "a room in Queens", None)], "id string, name string, borough string")
    assert prepare(df).first().neighbourhood_group == "Manhattan"
    assert prepare(df, infer_before_fill=True).first().neighbourhood_group == "Queens"


def test_missing_columns(spark):
    rows = [(None, "Unknown", "nan"), ("", "Soho", "Private room"), ("Bronx", "x", "y")]
    df = spark.createDataFrame(rows, "neighbourhood_group string, neighbourhood string, room_type string")
    found = [r[0] for r in df.select(missing.missing_columns(df)).collect()]
    assert found == [["neighbourhood_group", "neighbourhood", "room_type"], ["neighbourhood_group"], []]


def test_apply_joins_do_not_multiply_rows(spark):
    df = spark.createDataFrame([(1, "ыыы", "Unknown"), (1, "ыыы", "Soho"), (2, "ok", "Unknown")], "property_id long, description string, neighbourhood string")
    translations = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "property_id long, translated string")
    found = sorted(r.description for r in missing.apply_translations(df, translations).collect())
    assert found == ["b", "b", "ok"]
    inferences = spark.createDataFrame(
        [(1, "neighbourhood", "A"), (1, "neighbourhood", "B"), (2, "price_tier", "3")],
        "property_id long, col_name string, col_value string",
    )
    found = sorted(r.neighbourhood for r in missing.apply_inferences(df, inferences).collect())
    assert found == ["B", "B", "Unknown"]
