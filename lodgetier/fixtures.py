"""Listing tables derived from the given star-schema tables, by the same SQL in every engine.

The texts below use {braces} for table names. Spark fills in DataFrames, the checks fill in
names. Gaps, odd texts and repeated ids are planted with CASE expressions; every row of the
source tables takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgetier.runtime import materialise

BASE_TABLES = ("nation", "customer", "orders", "lineitem", "documents", "embeddings", "labels")

LISTINGS = """
WITH host AS (
  SELECT o_custkey AS hk, count(*) AS n_host FROM {orders} GROUP BY o_custkey
), li AS (
  SELECT l_orderkey AS lk, count(*) AS n_lines FROM {lineitem} GROUP BY l_orderkey
), base AS (
  SELECT o.o_orderkey AS property_id, o.o_totalprice AS total, o.o_orderstatus AS st,
         c.c_nationkey AS nk, n.n_name, n.n_regionkey AS rk, h.n_host,
         coalesce(li.n_lines, 0) AS n_lines,
         (o.o_orderkey * 7919) % 100003 AS h1, (o.o_orderkey * 104729) % 100019 AS h2
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
  JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  JOIN host h ON h.hk = o.o_custkey LEFT JOIN li ON li.lk = o.o_orderkey
)
SELECT property_id,
  CASE property_id % 8 WHEN 0 THEN 'Luxury penthouse with marble bath and skyline view'
    WHEN 1 THEN 'Cozy studio near the park' WHEN 2 THEN 'Shared room in a Queens hostel'
    WHEN 3 THEN 'Renovated lofts near Queensboro bridge, Brooklyn: balconies, two pools, great views' WHEN 4 THEN 'Private room in Brooklyn, basic'
    WHEN 5 THEN '' WHEN 7 THEN 'Уютная студия в центре' END AS description,
  CASE WHEN property_id % 29 = 0 THEN NULL ELSE CASE rk WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Brooklyn'
    WHEN 2 THEN 'Queens' WHEN 3 THEN 'Bronx' ELSE 'Staten Island' END END AS neighbourhood_group,
  CASE WHEN property_id % 17 = 0 THEN 'Unknown' ELSE n_name END AS neighbourhood,
  CASE WHEN property_id % 19 = 0 THEN NULL WHEN st = 'F' THEN 'Entire home/apt'
    WHEN st = 'O' THEN 'Private room' ELSE 'Shared room' END AS room_type,
  4055e-2 + 6e-2 * (nk % 5) + 5e-2 * h1 / 100003 AS latitude,
  -7415e-2 + 7e-2 * floor(nk / 5e0) + 6e-2 * h2 / 100019 AS longitude,
  CAST(n_lines * n_lines AS INT) AS minimum_nights, CAST(h1 % 151 AS INT) AS number_of_reviews,
  CAST(n_host AS INT) AS calculated_host_listings_count, CAST(h2 % 366 AS INT) AS availability_365,
  CAST(least(3, floor(4e0 * (5e-1 * total / 500000 + 5e-1 * nk / 25))) AS INT) AS price_tier
FROM base
"""

# Unlabelled listings from another table: categories the labelled ones lack, missing coordinates.
NEWCOMERS = """
SELECT c.c_custkey AS property_id,
  CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Whole loft with balcony' WHEN 'MACHINERY' THEN 'Private room, shared bathroom'
    WHEN 'HOUSEHOLD' THEN '' ELSE 'Quiet flat, elevator and river view' END AS description,
  CASE n.n_regionkey WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Brooklyn' WHEN 2 THEN 'Queens' WHEN 3 THEN 'Bronx'
    ELSE 'Jersey City' END AS neighbourhood_group,
  CASE WHEN c.c_mktsegment = 'FURNITURE' THEN 'Old Harbour' ELSE n.n_name END AS neighbourhood,
  CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Entire home/apt' WHEN 'MACHINERY' THEN 'Private room'
    WHEN 'HOUSEHOLD' THEN 'Shared room' ELSE 'Hotel room' END AS room_type,
  CASE WHEN c.c_acctbal >= 0 THEN 4055e-2 + 6e-2 * (c.c_nationkey % 5) + 5e-2 * ((c.c_custkey * 6151) % 100003) / 100003
    END AS latitude,
  CASE WHEN c.c_acctbal >= 0 THEN -7415e-2 + 7e-2 * floor(c.c_nationkey / 5e0)
    + 6e-2 * ((c.c_custkey * 49157) % 100019) / 100019 END AS longitude,
  CAST(c.c_custkey % 40 AS INT) AS minimum_nights, CAST(c.c_custkey % 130 AS INT) AS number_of_reviews,
  CAST(c.c_custkey % 25 AS INT) AS calculated_host_listings_count, CAST(c.c_custkey % 366 AS INT) AS availability_365
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

# Labelled listings with coordinates missing where the neighbourhood is unknown.
LOCATED = """
SELECT property_id, price_tier,
  CASE WHEN neighbourhood <> 'Unknown' THEN latitude END AS latitude,
  CASE WHEN neighbourhood <> 'Unknown' THEN longitude END AS longitude
FROM {listings}
"""

RAW = """
SELECT property_id AS id, description AS name, neighbourhood_group AS borough, neighbourhood AS area,
  room_type AS type,
  CASE WHEN property_id % 23 = 0 THEN 'abc' WHEN property_id % 31 = 0 THEN NULL
       WHEN property_id % 37 = 0 THEN '1d' WHEN property_id % 41 = 0 THEN 'NA'
       WHEN property_id % 43 = 0 THEN ' 2.9 ' WHEN property_id % 47 = 0 THEN '-.5e1'
       ELSE CAST(minimum_nights AS VARCHAR(20)) END AS min_nights,
  CAST(number_of_reviews AS VARCHAR(20)) AS reviews,
  CAST(latitude AS VARCHAR(40)) AS lat, CAST(longitude AS VARCHAR(40)) AS lng, 'x' AS extra_col
FROM {listings}
"""
RAW_NAMES = ("id", "Name ", "Borough", "area", "type", "Min Nights", "reviews", "lat", "lng", "extra_col")

# Some predictions wrong, some listings without one, some ids twice, some without a listing or a tier.
PREDICTIONS = """
SELECT property_id, CASE WHEN property_id % 3 = 0 THEN (price_tier + 1) % 4 ELSE price_tier END AS price_tier
FROM {listings} WHERE neighbourhood_group IS NOT NULL
UNION ALL SELECT property_id, 2 FROM {listings} WHERE room_type IS NULL
UNION ALL SELECT -1 - property_id, 0 FROM {listings} WHERE neighbourhood = 'Unknown'
UNION ALL SELECT property_id, CAST(NULL AS INT) FROM {listings} WHERE property_id % 13 = 0
"""

# Listings of which some have no tier.
PARTLY = """
SELECT property_id, description, neighbourhood_group, neighbourhood, room_type, latitude, longitude, minimum_nights,
  number_of_reviews, calculated_host_listings_count, availability_365,
  CASE WHEN property_id % 5 > 0 THEN price_tier END AS price_tier
FROM {listings}
"""

_SCORES = """
WITH r AS (
  SELECT property_id, price_tier, description,
    1e0 + (property_id * {m0}) % 97 + CASE WHEN price_tier = 0 AND property_id % {d} <> 0 THEN 60 ELSE 0 END AS r0,
    1e0 + (property_id * {m1}) % 97 + CASE WHEN price_tier = 1 AND property_id % {d} <> 0 THEN 60 ELSE 0 END AS r1,
    1e0 + (property_id * {m2}) % 97 + CASE WHEN price_tier = 2 AND property_id % {d} <> 0 THEN 60 ELSE 0 END AS r2,
    1e0 + (property_id * {m3}) % 97 + CASE WHEN price_tier = 3 AND property_id % {d} <> 0 THEN 60 ELSE 0 END AS r3
  FROM {listings})
SELECT property_id, price_tier, r0 / (r0 + r1 + r2 + r3) AS p0, r1 / (r0 + r1 + r2 + r3) AS p1,
  r2 / (r0 + r1 + r2 + r3) AS p2, r3 / (r0 + r1 + r2 + r3) AS p3
FROM r
"""
FIRST_SCORES = _SCORES.replace("{d}", "3")
for _i, _m in enumerate((13, 19, 29, 41)):
    FIRST_SCORES = FIRST_SCORES.replace(f"{{m{_i}}}", str(_m))
# The second scorer has no result for listings without a description.
SECOND_SCORES = _SCORES.replace("{d}", "4") + "WHERE description IS NOT NULL"
for _i, _m in enumerate((17, 23, 31, 43)):
    SECOND_SCORES = SECOND_SCORES.replace(f"{{m{_i}}}", str(_m))

RESPONSES = """
SELECT property_id,
  CASE property_id % 6 WHEN 0 THEN 'Tier 2' WHEN 1 THEN ' 3.' WHEN 2 THEN 'no idea'
    WHEN 3 THEN 'Sure: {{"has_luxury": true, "has_view": false, "is_shared": 1, "needs_work": "false", "has_amenities": []}} done'
    WHEN 4 THEN '{{broken' END AS response
FROM {listings}
"""

TRANSLATIONS = """
SELECT property_id, 'Cozy studio in the centre' AS translated FROM {listings}
WHERE description LIKE 'Уютная%' AND price_tier > 0
"""

# The second half names a column that may not be inferred.
INFERENCES = """
SELECT property_id, 'neighbourhood' AS col_name, 'Inferred' AS col_value FROM {listings}
WHERE neighbourhood = 'Unknown' AND price_tier <> 2
UNION ALL SELECT property_id, 'price_tier', '3' FROM {listings} WHERE neighbourhood = 'Unknown'
"""

VIEWS = {
    "listings": LISTINGS,
    "newcomers": NEWCOMERS,
    "located": LOCATED,
    "raw": RAW,
    "predictions": PREDICTIONS,
    "partly": PARTLY,
    "first_scores": FIRST_SCORES,
    "second_scores": SECOND_SCORES,
    "responses": RESPONSES,
    "translations": TRANSLATIONS,
    "inferences": INFERENCES,
}

_written: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables or derived views; listings are written once per session and folder."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    if name == "listings":
        key = (spark.sparkContext.applicationId, folder.rstrip("/"))
        if key not in _written:
            # The small given files would end up in one file, which one task would have to read.
            spread = _view(spark, folder, name).repartition(spark.sparkContext.defaultParallelism, "property_id")
            _written[key] = materialise(spread, "listings")
        return _written[key]
    return _view(spark, folder, name)


def _view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, folder, t) for t in (*BASE_TABLES, "listings") if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def raw_listings(spark: SparkSession, folder: str) -> DataFrame:
    """The raw view under the names it arrives with."""
    return table(spark, folder, "raw").toDF(*RAW_NAMES)


def vectors(scores: DataFrame, name: str) -> DataFrame:
    """(id, tier, vector) from the columns p0..p3."""
    return scores.select("property_id", "price_tier", F.array("p0", "p1", "p2", "p3").alias(name))


def with_views(body: str) -> str:
    """A DuckDB query with the derived views it names in front, as CTEs."""
    needed = [v for v in VIEWS if v != "listings" and v in body]
    if "listings" in body or any("{listings}" in VIEWS[v] for v in needed):
        needed.insert(0, "listings")
    names = {t: t for t in (*BASE_TABLES, *VIEWS)}
    ctes = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v].format(**names)})" for v in needed)
    body = body.strip()
    if not ctes:
        return body
    return f"WITH {ctes}, {body[4:].strip()}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}"
