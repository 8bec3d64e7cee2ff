"""Joins with hot keys give the same rows as plain joins."""

import pytest

from lodgetier import runtime


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys(spark, monkeypatch, how):
    monkeypatch.setattr(runtime, "HOT_SAMPLE", 1.0)
    rows = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 2 ELSE id END AS k", "id AS v"
    )
    lookup = spark.range(0, 2000, 1).selectExpr("id AS k", "id * 10 AS w")
    assert runtime.hot_keys(rows, ["k"], 100) is not None
    found = runtime.spread_join(rows, lookup, ["k"], how, hot_rows=100)
    expected = rows.join(lookup, "k", how)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.select(found.columns).collect()))


def test_no_hot_keys_is_a_plain_join(spark):
    rows, lookup = spark.range(100).toDF("k"), spark.range(50).selectExpr("id AS k", "id AS w")
    plan = runtime.spread_join(rows, lookup, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_hot_list_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_SAMPLE", 1.0)
    monkeypatch.setattr(runtime, "HOT_KEYS", 3)
    rows = spark.range(1000).selectExpr("id % 10 AS k")
    assert runtime.hot_keys(rows, ["k"], 1).count() == 3


def test_small_or_spread(spark, monkeypatch):
    rows, lookup = spark.range(100).toDF("k"), spark.range(50).selectExpr("id AS k", "id AS w")
    small = runtime.small_or_spread_join(rows, lookup, ["k"])
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 10)
    large = runtime.small_or_spread_join(rows, lookup, ["k"])
    assert sorted(small.collect()) == sorted(large.collect())
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()


class _Session:
    """Just enough of a session to ask where scratch tables go."""

    def __init__(self, master, shared):
        self.conf = self
        self.sparkContext = self
        self.master, self.shared, self.applicationId = master, shared, f"app-{master}-{shared}"

    def get(self, key, default=None):
        return self.shared if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return None


def test_scratch_folder():
    assert runtime.scratch_dir(_Session("yarn", "hdfs:///shared/")).startswith("hdfs:///shared/lodgetier-app")
    with pytest.raises(RuntimeError):
        runtime.scratch_dir(_Session("yarn", None))
    local = _Session("local[2]", None)
    assert runtime.scratch_dir(local) == runtime.scratch_dir(local)
