"""Areas by clustering: few passes over the places, whatever their number, and centres at rest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgetier.operators import geo


@pytest.mark.parametrize("k", [5, 15])
def test_evenly_spread_places_rest_after_few_passes(spark, monkeypatch, k):
    """A narrow border stands for many more places; centres must not creep over many passes."""
    places = spark.range(200_000).select(F.rand(3).alias("latitude"), (F.rand(4) * 1.5).alias("longitude"))
    places = geo.materialise(places, "even")
    monkeypatch.setattr(geo, "BORDER", 1_000)
    monkeypatch.setattr(geo, "SHARED_BORDER", 1_000, raising=False)
    passes = []
    once = geo._passed
    monkeypatch.setattr(geo, "_passed", lambda *given: passes.append(1) or once(*given))
    centres = np.array(geo.fit_centres(places, k, restarts=2))
    assert len(passes) <= 8
    x = np.array(places.collect())
    which = np.argmin(((x[:, None, :] - centres[None]) ** 2).sum(axis=2), axis=1)
    means = np.array([x[which == i].mean(axis=0) for i in range(k)])
    assert np.abs(means - centres).max() < 1e-6


def test_one_place_and_fewer_places_than_centres(spark):
    one = spark.createDataFrame([(40.5, -74.0)] * 3, "latitude double, longitude double")
    assert set(geo.fit_centres(one, 2, restarts=2)) == {(40.5, -74.0)}
    two = one.union(spark.createDataFrame([(41.0, -73.0)], one.schema))
    assert {(40.5, -74.0), (41.0, -73.0)} <= set(geo.fit_centres(two, 3, restarts=3))


def test_centres_that_go_round_in_circles_rest(monkeypatch):
    """Sums that lead back to an earlier place end the search, long before the most steps."""
    cells = np.array([[1.0, 0.0, 0.0], [1.0, 0.0, 1.0]])
    steps = []

    def turning(border, centres, sides):
        steps.append(1)
        return np.array([[1.0, 0.0, (len(steps) % 3) * 1e-3], [1.0, 0.0, 1.0]]) - geo._moments(cells[:0], np.zeros(0, dtype=int), 2)

    monkeypatch.setattr(geo, "_shared", turning)
    monkeypatch.setattr(geo, "_moments", lambda cells, which, k: np.zeros((k, 3)))
    geo._rested(cells, np.array([[0.0, 0.0], [0.0, 1.0]]), np.array([1.0, 1.0]))
    assert len(steps) < 10


def test_many_centres_are_a_loop_with_the_same_result(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = [(float(y), float(x)) for y, x in rng.random((30, 2)).round(1)]
    centres += centres[:3]  # equal ones: the first is taken
    places = [(float(y), float(x)) for y, x in rng.random((500, 2)).round(2)] + [(None, 0.5), (0.5, None)]
    df = spark.createDataFrame(places, "lat double, lon double").select("*", geo.nearest_centre(F.col("lat"), F.col("lon"), centres).alias("at"))
    assert df._jdf.queryExecution().analyzed().toString().count("SQRT") <= 2
    monkeypatch.setattr(geo, "WRITTEN_OUT", 100)
    plain = df.select("*", geo.nearest_centre(F.col("lat"), F.col("lon"), centres).alias("plain")).collect()
    assert all(r.at == r.plain for r in plain) and [r.at for r in plain[-2:]] == [None, None]
