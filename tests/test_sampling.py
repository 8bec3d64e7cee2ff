"""Splits and samples are exact and repeatable, also with hot ids and full copies."""

from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodgetier.operators import sampling


def table(spark, n=2000, ids="id", tier="id % 3"):
    return spark.range(n).selectExpr(f"{ids} AS property_id", f"CAST({tier} AS INT) AS price_tier", "id AS payload")


@given(st.dictionaries(st.integers(0, 9).map(str), st.integers(1, 10**6), min_size=1), st.floats(0, 1))
def test_quotas_add_up(counts, share):
    wanted = int(share * sum(counts.values()))
    quotas = sampling.proportional_quotas(counts, wanted)
    assert sum(quotas.values()) == wanted
    for c, n in counts.items():
        assert abs(quotas[c] - wanted * n / sum(counts.values())) < 1 and 0 <= quotas[c] <= n


def sides(df):
    return Counter((r.price_tier, r.is_validation) for r in df.collect())


def test_split_sizes(spark):
    found = sides(sampling.stratified_split(table(spark, 1999)))
    assert sum(n for (_, held), n in found.items() if held) == 200
    assert {found[t, True] for t in range(3)} <= {66, 67}


def test_split_is_repeatable_and_seeded(spark):
    def held(df, **kw):
        return {r.payload for r in sampling.stratified_split(df, **kw).where("is_validation").collect()}

    df = table(spark)
    assert held(df) == held(df.repartition(5, "payload")) != held(df, seed=43)


@pytest.mark.parametrize(
    "ids", ["CASE WHEN id % 3 = 0 THEN 7 ELSE id END", "7", "CASE WHEN id % 2 = 0 THEN NULL ELSE id END"]
)
def test_split_is_exact_when_an_id_is_hot(spark, ids):
    df = table(spark, 2000, ids, "id % 2")
    split = sampling.stratified_split(df)
    found = sides(split)
    assert (found[0, True], found[1, True]) == (100, 100)
    assert sorted(r.payload for r in split.collect()) == list(range(2000))


def test_full_copies_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPIES_PER_CHUNK", 7)
    df = spark.range(1000).selectExpr("7 AS property_id", "1 AS price_tier", "'x' AS payload")
    assert sides(sampling.stratified_split(df)) == {(1, True): 100, (1, False): 900}
    folds = Counter(r.fold for r in sampling.kfold(df, 7).collect())
    assert sorted(folds.values()) == [142, 143, 143, 143, 143, 143, 143] and set(folds) == set(range(7))


def test_rows_without_a_class(spark):
    df = table(spark, 1000, "7", "CASE WHEN id % 2 = 0 THEN id % 4 END")
    assert sides(sampling.stratified_split(df)) == {
        (None, True): 50, (None, False): 450, (0, True): 25, (0, False): 225, (2, True): 25, (2, False): 225
    }


def test_kfold_sizes(spark):
    folds = Counter(r.fold for r in sampling.kfold(table(spark, 1003), 5).collect())
    assert sorted(folds.values()) == [200, 200, 201, 201, 201] and set(folds) == set(range(5))


def test_more_folds_than_rows(spark):
    folds = Counter(r.fold for r in sampling.kfold(table(spark, 3), 5).collect())
    assert sorted(folds) == [0, 1, 2]


def test_per_class_sample(spark):
    df = table(spark, 100, tier="CASE WHEN id < 2 THEN 9 ELSE id % 2 END")
    found = Counter(r.price_tier for r in sampling.per_class_sample(df, 5).collect())
    assert found == {0: 5, 1: 5, 9: 2}


@pytest.mark.parametrize("n, expected", [(0, 0), (17, 17), (5000, 2000)])
def test_subset(spark, n, expected):
    assert sampling.subset_n(table(spark), n).count() == expected


def test_empty_table(spark):
    empty = table(spark, 0)
    assert sampling.stratified_split(empty).count() == sampling.kfold(empty).count() == 0


def test_split_is_a_filter(spark, sf):
    from lodgetier.fixtures import table as given_table

    split = sampling.stratified_split(given_table(spark, sf, "listings").select("property_id", "price_tier"))
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_class_counts_refuses_text(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MAX_CLASSES", 10)
    with pytest.raises(ValueError):
        sampling.class_counts(table(spark).withColumn("t", F.col("payload")), "t")
