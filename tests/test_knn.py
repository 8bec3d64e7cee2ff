"""The neighbour search against comparing all pairs, over places of very uneven density."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lodgetier.operators import knn


def brute(train, queries, k, folds):
    x, y = train.latitude.fillna(0).to_numpy(), train.longitude.fillna(0).to_numpy()
    ids, tiers = train.property_id.to_numpy(), train.price_tier.to_numpy()
    out = []
    for _, q in queries.iterrows():
        d = np.sqrt((x - np.nan_to_num(q.latitude)) ** 2 + (y - np.nan_to_num(q.longitude)) ** 2)
        use = train.fold.to_numpy() != q.fold if folds else np.ones(len(train), bool)
        order = np.lexsort((ids[use], d[use]))[:k]
        near, tier = d[use][order], tiers[use][order]
        weight = (near == 0).astype(float) if near[0] == 0 else 1 / near
        out.append(int(np.argmax([weight[tier == t].sum() for t in range(4)])))
    return out


def places(seed, n):
    """A third dense, a third very dense, the rest wide apart; some coincide, some are missing."""
    rng = np.random.default_rng(seed)
    third = n // 3
    lat = np.concatenate([rng.normal(40.7, 0.05, third), rng.normal(40.7, 0.0005, third), rng.uniform(30, 50, n - 2 * third)])
    lon = np.concatenate([rng.normal(-74, 0.05, third), rng.normal(-74, 0.0005, third), rng.uniform(-80, -70, n - 2 * third)])
    lat[::10] = lon[::10] = np.nan
    lat[1::9], lon[1::9] = 41.0, -74.0
    return pd.DataFrame(
        {
            "property_id": rng.permutation(n),
            "latitude": lat,
            "longitude": lon,
            "price_tier": rng.integers(0, 4, n),
            "fold": rng.integers(0, 5, n),
        }
    )


def found(df):
    return [r.geo_tier for r in df.orderBy("property_id").collect()]


@pytest.mark.parametrize("cell_points", [128, 20])
def test_out_of_fold(spark, monkeypatch, cell_points):
    monkeypatch.setattr(knn, "CELL_POINTS", cell_points)
    rows = places(0, 900).sort_values("property_id")
    assert found(knn.knn_tier_out_of_fold(spark.createDataFrame(rows))) == brute(rows, rows, 15, True)


@pytest.mark.parametrize("tile, searches, pairs", [(0, 5, 1), (2, 40, 1000)])
def test_small_tiles_and_parts(spark, monkeypatch, tile, searches, pairs):
    """Tiles share the points on their edges, and parts of a tile its points; results don't depend on either."""
    for name, value in (("TILE", tile), ("TILE_SEARCHES", searches), ("CELL_POINTS", 30)):
        monkeypatch.setattr(knn, name, value)
    rows = places(5, 900).sort_values("property_id")
    assert found(knn.knn_tier_out_of_fold(spark.createDataFrame(rows))) == brute(rows, rows, 15, True)


def test_blocks_of_a_tile_against_all_its_points(monkeypatch):
    """Searches are settled by the cells around them; equals at the last place go by their order of arrival."""
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 64, (2, 500)) / 8
    f, tier = rng.integers(0, 3, 500), rng.integers(0, 4, 500)
    cells = [np.floor(v).astype(np.int64) for v in (x, y)]
    rows = pa.RecordBatch.from_pydict(dict(zip(("x", "y", "f", "tier", "cx", "cy"), (x, y, f, tier, *cells))))
    monkeypatch.setattr(knn, "HELD_PAIRS", 700)
    tile = knn._Tile([(knn._POINT, rows)], 0, 0, 3)
    inside = np.minimum.reduce([x - cells[0], cells[0] + 1 - x, y - cells[1], cells[1] + 1 - y])
    got = tile.tiers(x, y, f, *cells, 1 + inside, 5)
    assert (got >= 0).mean() > 0.8
    for i in np.flatnonzero(got >= 0):
        d = np.where(f == f[i], np.inf, np.sqrt((x - x[i]) ** 2 + (y - y[i]) ** 2))
        near = np.lexsort((np.arange(500), d))[:5]
        weight = d[near] == 0 if d[near[0]] == 0 else 1 / d[near]
        votes = np.bincount(tier[near], weight, minlength=4)
        assert votes[got[i]] > votes.max() - 1e-9


def test_descent_alone(spark, monkeypatch):
    grid = knn._survey
    monkeypatch.setattr(knn, "_survey", lambda *a: (grid(*a)[0], []))
    train, queries = places(1, 600), places(2, 200).sort_values("property_id")
    df = knn.knn_tier(spark.createDataFrame(train), spark.createDataFrame(queries).drop("price_tier"))
    assert found(df) == brute(train, queries, 15, False)


def test_sampled_survey(spark, monkeypatch):
    monkeypatch.setattr(knn, "SAMPLE_POINTS", 50)
    train, queries = places(3, 900), places(4, 100).sort_values("property_id")
    df = knn.knn_tier(spark.createDataFrame(train), spark.createDataFrame(queries), k=3)
    assert found(df) == brute(train, queries, 3, False)


def test_few_rows_and_ties(spark):
    schema = "property_id long, latitude double, longitude double, price_tier int"
    train = spark.createDataFrame([(1, 0.0, 1.0, 3), (2, 0.0, -1.0, 1)], schema)
    queries = spark.createDataFrame([(9, 0.0, 0.0, None), (10, 0.0, 1.0, None), (11, None, None, None)], schema)
    assert found(knn.knn_tier(train, queries)) == [1, 3, 1], "equal votes go to the lower tier"


def test_no_labelled_rows(spark):
    schema = "property_id long, latitude double, longitude double, price_tier int"
    queries = spark.createDataFrame([(9, 0.0, 0.0, None)], schema)
    assert found(knn.knn_tier(queries, queries)) == [None]


def test_coinciding_rows_are_reduced_before_the_search(spark):
    train = spark.range(5000).selectExpr(
        "id AS property_id", "40e0 AS latitude", "-74e0 AS longitude", "CAST(id % 4 AS INT) AS price_tier"
    )
    places = knn._places(train, None, 15, "property_id")
    assert [r.pid for r in places.orderBy("pid").collect()] == list(range(15))
    assert found(knn.knn_tier(train, train.limit(3))) == [0, 0, 0]


def test_crowded_places_are_limited_before_the_shuffle(spark, sf, monkeypatch):
    from lodgetier.fixtures import table

    monkeypatch.setattr(knn, "materialise", lambda df, name: df)
    plan = knn._places(table(spark, sf, "located"), None, 15, "property_id")._jdf.queryExecution().executedPlan()
    assert plan.toString().count("WindowGroupLimit") == 2 and "Partial" in plan.toString()
