"""DuckDB queries that give the expected result of each registered query.

They run over the whole tables. Only plain SQL is used, written apart from the Spark code.
"""

from __future__ import annotations

from lodgetier.constants import TIER_NAMES
from lodgetier.fixtures import with_views

_NA = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', "
    "'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
)


def _na(c: str) -> str:
    return f"CASE WHEN {c} NOT IN {_NA} THEN {c} END"


def _num(x: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({x}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') "
        f"THEN TRY_CAST(trim({x}) AS DOUBLE) END"
    )


def _int(x: str) -> str:
    return f"CAST(trunc({_num(x)}) AS BIGINT)"


def _strip(x: str) -> str:
    return f"nullif(trim({x}), '')"


def _nights(n: str) -> str:
    return (
        f"CASE WHEN {n} <= 1 THEN 'flexible stay (1 night minimum)' WHEN {n} <= 3 THEN 'short stay (' || {n} || ' night minimum)' "
        f"WHEN {n} <= 7 THEN 'weekly stay (' || {n} || ' night minimum)' WHEN {n} <= 30 THEN 'extended stay (' || {n} || ' night minimum)' "
        f"WHEN {n} > 30 THEN 'long-term stay (' || {n} || ' night minimum)' END"
    )


def _reviews(n: str) -> str:
    return (
        f"CASE WHEN {n} = 0 THEN 'new listing, no reviews yet' WHEN {n} <= 5 THEN 'very few reviews (' || {n} || ')' "
        f"WHEN {n} <= 20 THEN 'few reviews (' || {n} || ')' WHEN {n} <= 50 THEN 'several reviews (' || {n} || ')' "
        f"WHEN {n} <= 100 THEN 'many reviews (' || {n} || ')' WHEN {n} > 100 THEN 'highly reviewed (' || {n} || ' reviews)' END"
    )


def _availability(n: str, reviews: str | None = None) -> str:
    new = f"WHEN {n} <= 30 AND {reviews} = 0 THEN 'new listing, availability unknown' " if reviews else ""
    return (
        f"CASE {new}WHEN {n} <= 30 THEN 'rarely available, almost always booked' "
        f"WHEN {n} <= 90 THEN 'occasionally available (' || {n} || ' days/year)' "
        f"WHEN {n} <= 180 THEN 'often available (' || {n} || ' days/year)' "
        f"WHEN {n} > 180 THEN 'frequently available (' || {n} || ' days/year)' END"
    )


def _host(n: str) -> str:
    return (
        f"CASE WHEN {n} = 1 THEN 'individual host' WHEN {n} <= 5 THEN 'small host (' || {n} || ' listings)' "
        f"WHEN {n} <= 20 THEN 'professional host (' || {n} || ' listings)' "
        f"WHEN {n} > 20 THEN 'large property manager (' || {n} || ' listings)' END"
    )


def _w_room(x: str) -> str:
    t = f"coalesce(lower(trim({x})), '')"
    return (
        f"CASE {t} WHEN 'entire home/apt' THEN 'an entire home or apartment, the whole private unit to themselves' "
        f"WHEN 'private room' THEN 'a private room within a shared home' "
        f"WHEN 'shared room' THEN 'a shared room, the most budget level of space' ELSE {t} END"
    )


def _w_reviews(n: str, med: str = "5") -> str:
    return (
        f"CASE WHEN {n} = 0 THEN 'a brand-new listing with no reviews yet' WHEN {n} >= 4 * {med} THEN 'a very well-reviewed listing' "
        f"WHEN {n} >= {med} THEN 'a moderately reviewed listing' WHEN {n} IS NOT NULL THEN 'a lightly reviewed listing' END"
    )


def _w_host(n: str) -> str:
    return (
        f"CASE WHEN {n} = 1 THEN 'run by an individual host who lists only this one place' "
        f"WHEN {n} <= 3 THEN 'run by a small host with a handful of listings' "
        f"WHEN {n} <= 15 THEN 'run by a professional host managing many listings' "
        f"WHEN {n} > 15 THEN 'run by a large property-management operation' END"
    )


def _w_availability(n: str, med: str = "37") -> str:
    return (
        f"CASE WHEN {n} = 0 THEN 'with a fully blocked calendar this year' WHEN {n} <= {med} THEN 'with a tighter-than-typical calendar' "
        f"WHEN {n} <= 2 * {med} THEN 'with a moderately open calendar' "
        f"WHEN {n} > 2 * {med} THEN 'with a much more open calendar than usual' END"
    )


def _w_nights(n: str) -> str:
    return (
        f"CASE WHEN {n} <= 1 THEN 'bookable for a single night' WHEN {n} <= 30 THEN 'open to short stays' "
        f"WHEN {n} > 30 THEN 'geared to long-term stays' END"
    )


def _place(start: str, between: str) -> str:
    a, b = _strip("neighbourhood"), _strip("neighbourhood_group")
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN '{start}' || {a} || '{between}' || {b} WHEN {b} IS NOT NULL THEN 'located in ' || {b} END"


_CENTRES = (
    "(0, 40.7829, -73.9654), (1, 40.7195, -74.0089), (2, 40.7736, -73.9566), (3, 40.7549, -73.9840), "
    "(4, 40.7233, -74.0030), (5, 41.9, -70.0)"
)
_ASSIGNED = f"""centres(cluster, clat, clon) AS (VALUES {_CENTRES}),
ranked AS (
  SELECT l.*, c.cluster, row_number() OVER (PARTITION BY l.property_id
    ORDER BY sqrt((l.latitude - c.clat) ** 2 + (l.longitude - c.clon) ** 2), c.cluster) AS rn
  FROM listings l CROSS JOIN centres c),
assigned AS (SELECT * FROM ranked WHERE rn = 1)"""
_LABEL = (
    "CASE WHEN m >= 0 AND m < 0.75 THEN 'budget area' WHEN m >= 0.75 AND m < 1.5 THEN 'standard area' "
    "WHEN m >= 1.5 AND m < 2.25 THEN 'premium area' ELSE 'luxury district' END"
)
_LABELLED = f"""{_ASSIGNED},
area AS (SELECT cluster, {_LABEL} AS geo_label FROM (SELECT cluster, avg(price_tier) AS m FROM assigned GROUP BY cluster))"""


def _row_text(*parts: str) -> str:
    return "concat_ws('. ', " + ", ".join(f"nullif({p}, '')" for p in parts) + ") || '.'"


_PLAIN_INTS = {
    "n_nights": "minimum_nights",
    "n_reviews": "number_of_reviews",
    "n_host": "calculated_host_listings_count",
    "n_avail": "availability_365",
}


def _hash(seed: int, key: str = "property_id") -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 15))::BIGINT"


# Distance-weighted vote of the 15 nearest labelled rows, by comparing all pairs.
def _knn(queries: str, train: str, condition: str, key: str = "property_id") -> str:
    return f"""
q AS (SELECT *, coalesce(latitude, 0) AS x, coalesce(longitude, 0) AS y FROM {queries}),
t AS (SELECT *, coalesce(latitude, 0) AS x, coalesce(longitude, 0) AS y FROM {train}),
near AS (
  SELECT q.{key}, unnest(min({{'d': sqrt((q.x - t.x) ** 2 + (q.y - t.y) ** 2), 'id': t.property_id, 'tier': t.price_tier}}, 15)) AS e
  FROM q JOIN t ON {condition} GROUP BY q.{key}),
closest AS (SELECT {key}, min(e.d) AS d0 FROM near GROUP BY {key}),
votes AS (
  SELECT near.{key}, e.tier AS tier, sum(CASE WHEN d0 > 0 THEN 1 / e.d WHEN e.d = 0 THEN 1 ELSE 0 END) AS v
  FROM near JOIN closest USING ({key}) GROUP BY ALL),
knn AS (SELECT {key}, first(tier ORDER BY v DESC, tier) AS geo_tier FROM votes GROUP BY {key})"""


_FOLDS = f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY {_hash(42)}, property_id) AS rn, count(*) OVER () AS n FROM listings),
folds AS (
  SELECT * EXCLUDE (rn, n), CAST(CASE WHEN rn <= (n % 5) * (n // 5 + 1) THEN (rn - 1) // (n // 5 + 1)
    ELSE (n % 5) + (rn - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INT) AS fold FROM numbered)"""
_LOCATED_FOLDS = """
lf AS (SELECT l.*, f.fold FROM located l JOIN folds f USING (property_id))"""
_OOF = _FOLDS + "," + _LOCATED_FOLDS + "," + _knn("lf", "lf", "q.fold <> t.fold")

_QUOTAS = """
sizes AS (SELECT price_tier, count(*) AS c FROM listings GROUP BY price_tier),
total AS (SELECT sum(c) AS n, ceil(sum(c) / 10) AS want FROM sizes),
exact AS (SELECT price_tier, want * c / n AS x, floor(want * c / n) AS f, want FROM sizes, total),
quotas AS (
  SELECT price_tier, CAST(f + CASE WHEN row_number() OVER (ORDER BY x - f DESC, price_tier) <= want - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota
  FROM exact)"""

_EVAL = """
counts AS (
  SELECT l.price_tier AS t, p.price_tier AS p, count(*) AS n
  FROM {p} p JOIN {l} l ON p.property_id = l.property_id
  WHERE p.price_tier IS NOT NULL AND l.price_tier IS NOT NULL GROUP BY ALL)"""
_SCORES = """
classes AS (SELECT t AS tier FROM counts UNION SELECT p FROM counts),
scores AS (
  SELECT tier, coalesce((SELECT sum(n) FROM counts WHERE t = tier), 0) AS support,
    coalesce((SELECT sum(n) FROM counts WHERE p = tier), 0) AS called,
    coalesce((SELECT sum(n) FROM counts WHERE p = tier AND t = tier), 0) AS hit FROM classes),
measured AS (
  SELECT *, coalesce(hit / nullif(called, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall,
    2 * hit / (called + support) AS f1 FROM scores)"""
_REPORT = """
names(tier, name) AS (VALUES (0, 'Budget'), (1, 'Standard'), (2, 'Premium'), (3, 'Ultra-Luxury')),
four AS (
  SELECT n.tier, n.name, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, coalesce(f1, 0) AS f1,
    coalesce(support, 0) AS support, coalesce(hit, 0) AS hit FROM names n LEFT JOIN measured m ON m.tier = n.tier),
report AS (
  SELECT tier AS position, name, precision, recall, f1, support FROM four
  UNION ALL SELECT 4, 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM four
  UNION ALL SELECT 5, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM four
  UNION ALL SELECT 6, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM four)"""
_RECORD = """
record AS (
  SELECT round((SELECT avg(f1) FROM measured), 4) AS macro_f1, CAST((SELECT sum(n) FROM counts) AS BIGINT) AS n_evaluated,
    (SELECT '              precision    recall  f1-score   support' || chr(10) || chr(10) || string_agg(
      CASE WHEN position = 4 THEN chr(10) ELSE '' END ||
      CASE WHEN name = 'accuracy' THEN printf('%12s  %9s %9s %9.2f %9d', name, '', '', f1, CAST(support AS BIGINT))
        ELSE printf('%12s  %9.2f %9.2f %9.2f %9d', name, precision, recall, f1, CAST(support AS BIGINT)) END,
      chr(10) ORDER BY position) || chr(10) FROM report) AS report,
    CAST(NULL AS VARCHAR) AS error)"""


def _evaluated(predictions: str, labels: str) -> str:
    return _EVAL.format(p=predictions, l=labels) + "," + _SCORES


_VOTE_ROWS = """
paired AS (
  SELECT a.property_id, a.price_tier AS t, [a.p0, a.p1, a.p2, a.p3] AS va,
    CASE WHEN b.p0 IS NOT NULL THEN [b.p0, b.p1, b.p2, b.p3] END AS vb
  FROM first_scores a LEFT JOIN second_scores b ON a.property_id = b.property_id)"""


def _voted(weights: str) -> str:
    return f"""{_VOTE_ROWS},
w(weight) AS (VALUES {weights}),
mixed AS (
  SELECT weight, t, CASE WHEN vb IS NULL THEN va ELSE [weight * va[i] + (1 - weight) * vb[i] FOR i IN range(1, 5)] END AS v
  FROM paired CROSS JOIN w),
called AS (SELECT weight, t, list_position(v, list_max(v)) - 1 AS p FROM mixed),
counts AS (SELECT weight, t, p, count(*) AS n FROM called GROUP BY ALL),
classes AS (SELECT weight, t AS tier FROM counts UNION SELECT weight, p FROM counts),
per AS (
  SELECT c.weight, c.tier, 2 * coalesce(sum(n) FILTER (t = c.tier AND p = c.tier), 0)
    / (coalesce(sum(n) FILTER (t = c.tier), 0) + coalesce(sum(n) FILTER (p = c.tier), 0)) AS f1
  FROM classes c JOIN counts k ON k.weight = c.weight GROUP BY ALL),
f1s AS (SELECT weight, avg(f1) AS macro_f1 FROM per GROUP BY weight)"""


_CLEAN = f"""
cleaned AS (
  SELECT id AS property_id, coalesce(name, '') AS description, coalesce(borough, 'Manhattan') AS neighbourhood_group,
    coalesce(area, 'Unknown') AS neighbourhood, coalesce(type, 'Entire home/apt') AS room_type,
    coalesce({_num('min_nights')}, 1) AS minimum_nights, coalesce({_num('reviews')}, 0) AS number_of_reviews,
    coalesce({_num('lat')}, 40.7128) AS latitude, coalesce({_num('lng')}, -74.006) AS longitude,
    extra_col, 1e0 AS calculated_host_listings_count, 180e0 AS availability_365
  FROM raw)"""

_EXAMPLE = (
    "'Description: ' || coalesce(description, 'nan') || ' | Neighbourhood group: ' || coalesce(neighbourhood_group, 'nan') "
    "|| ' | Neighbourhood: ' || neighbourhood || ' | Room type: ' || coalesce(room_type, 'nan') || ' | Min nights: ' || minimum_nights "
    "|| ' | Reviews: ' || number_of_reviews || ' | Availability: ' || availability_365"
)
_BLOCK = f"""
picked AS (SELECT *, row_number() OVER (PARTITION BY price_tier ORDER BY {_hash(42)}, property_id) AS rn FROM partly WHERE price_tier IS NOT NULL),
example_block AS (
  SELECT string_agg('  ' || {_EXAMPLE} || ' → ' || price_tier, chr(10) ORDER BY {_hash(43)}, property_id) AS block
  FROM picked WHERE rn <= 3)"""

_FOREIGN = "coalesce(length(regexp_replace({t}, '[\\x00-\\x7F]', '', 'g')) / nullif(length({t}), 0) > 0.15, false)"
_GAP = "({c} IS NULL OR {c} IN ('', 'Unknown', 'nan'))"


def _flag(text: str, words: str) -> str:
    return f"CAST(coalesce(regexp_matches(lower({text}), '(^|[^a-z])({words})s?([^a-z]|$)'), false) AS INT)"


def _flags(text: str) -> str:
    return ", ".join(
        f"{_flag(text, words)} AS {name}"
        for name, words in {
            "has_luxury": "luxury|luxuries|penthouse|marble|doorman|concierge|high-end",
            "has_view": "view|skyline|park view|river|city view",
            "has_outdoor": "rooftop|balcony|balconies|terrace|garden|patio",
            "is_shared": "shared bathroom|shared room|hostel|dormitory|dormitories",
            "needs_work": "renovation|repair|fixer|worn|basic",
            "has_amenities": "pool|gym|spa|elevator|fireplace",
        }.items()
    )


def _mention(text: str, *values: str) -> str:
    def place(value: str) -> str:
        pattern = f"(^|[^a-z0-9]){value.lower()}([^a-z0-9]|$)"
        before = f"regexp_extract(lower({text}), '(?s)^(.*?){pattern}', 1)"
        return f"CASE WHEN regexp_matches(lower({text}), '{pattern}') THEN length({before}) + 1 ELSE 0 END"

    found = ", ".join(f"{{'at': {place(v)}, 'value': '{v}'}}" for v in values)
    return f"list_sort(list_filter([{found}], lambda m: m.at > 0))[1].value"


def _json_flag(name: str) -> str:
    v = f"json_extract(j, '$.{name}')"
    return f"""CAST(CASE WHEN j IS NULL OR {v} IS NULL THEN 0 WHEN json_type({v}) = 'NULL' THEN 0
      WHEN json_type({v}) = 'BOOLEAN' THEN CASE WHEN CAST({v} AS VARCHAR) = 'true' THEN 1 ELSE 0 END
      WHEN json_type({v}) = 'VARCHAR' THEN CASE WHEN CAST({v} AS VARCHAR) <> '""' THEN 1 ELSE 0 END
      WHEN json_type({v}) IN ('ARRAY', 'OBJECT') THEN CASE WHEN CAST({v} AS VARCHAR) NOT IN ('[]', '{{}}') THEN 1 ELSE 0 END
      ELSE CASE WHEN CAST({v} AS DOUBLE) <> 0 THEN 1 ELSE 0 END END AS INT) AS {name}"""


_JSON_FLAGS = ", ".join(
    _json_flag(f) for f in ("has_luxury", "has_view", "has_outdoor", "is_shared", "needs_work", "has_amenities")
)


_TELLING = (
    "train_tabular train_boosted holdout_eval best_configuration fused_text_classifier fused_text_classifier_plain "
    "fused_text_classifier_qualitative area_text_classifier vectors_tabular flags_tabular"
).split()


def _held_out(telling: bool = True) -> str:
    """The lines of a report on the validation rows, as far as they are determined."""
    names = " ".join(f"WHEN {tier} THEN '{name}'" for tier, name in enumerate(TIER_NAMES))
    more = ", true AS valid" + ", true AS beats_largest" * telling
    averages = " ".join(
        f"UNION ALL SELECT {i}, '{name}', CAST(sum(quota) AS BIGINT){more} FROM quotas"
        for i, name in enumerate(("accuracy", "macro avg", "weighted avg"), 4)
    )
    return f"""WITH {_QUOTAS} SELECT CAST(price_tier AS INT) AS position, CASE price_tier {names} END AS name,
      quota AS support{more} FROM quotas {averages}"""


def oracle_sql() -> dict[str, str]:
    n = _PLAIN_INTS
    hot = {
        "central_park": (40.7829, -73.9654),
        "tribeca": (40.7195, -74.0089),
        "upper_east_side": (40.7736, -73.9566),
        "midtown": (40.7549, -73.9840),
        "soho": (40.7233, -74.0030),
    }
    distances = ", ".join(
        f"round(sqrt((latitude - ({a})) ** 2 + (longitude - ({b})) ** 2), 9) AS dist_{h}" for h, (a, b) in hot.items()
    )
    boroughs = "SELECT DISTINCT neighbourhood_group AS c FROM listings WHERE neighbourhood_group IS NOT NULL"
    rooms = "SELECT DISTINCT room_type AS c FROM listings WHERE room_type IS NOT NULL"

    def hot_columns(column: str, cats: str, width: int) -> str:
        return ", ".join(
            f"coalesce(CAST(n.{column} = (SELECT c FROM ({cats}) ORDER BY c LIMIT 1 OFFSET {i}) AS INT), 0) AS {column}_{i}"
            for i in range(width)
        )

    sql = {
        # sources
        "read_listings": f"SELECT CAST(id AS VARCHAR) AS id, {', '.join(_na(c) + ' AS ' + c for c in ('name', 'borough', 'area', 'type', 'min_nights', 'reviews', 'lat', 'lng', 'extra_col'))} FROM raw",
        "na_tokens": f"SELECT id, {', '.join(_na(c) + ' AS ' + c for c in ('name', 'borough', 'area', 'type', 'min_nights', 'reviews', 'lat', 'lng', 'extra_col'))} FROM raw",
        "predictions_out": "SELECT property_id, price_tier FROM predictions",
        "records_json": "SELECT * FROM listings",
        "split_inputs": """SELECT 'data' AS role, count(*) AS n, count(description) AS described, CAST(NULL AS BIGINT) AS tier_sum FROM listings
            UNION ALL SELECT 'labels', count(*), NULL, CAST(sum(price_tier) AS BIGINT) FROM predictions""",
        "model_roundtrip": "SELECT count(*) AS n, count(*) AS same FROM listings",
        "stream_score": "SELECT count(*) AS n, count(*) AS same FROM raw",
        "read_mixed_headers": f"""SELECT CAST(id AS VARCHAR) AS property_id, {', '.join(_na(c) + ' AS ' + n_ for c, n_ in (('name', 'description'), ('borough', 'neighbourhood_group'), ('area', 'neighbourhood'), ('type', 'room_type'), ('min_nights', 'minimum_nights'), ('reviews', 'number_of_reviews'), ('lat', 'latitude'), ('lng', 'longitude')))} FROM raw""",
        **{name: _held_out() for name in _TELLING},
        **{name: _held_out(False) for name in ("vectors_only",)},
        "geo_kmeans": "SELECT CAST(15 AS BIGINT) AS clusters, count(*) AS n, true AS settled FROM listings",
        "predict_tabular": "SELECT property_id, true AS valid FROM newcomers",
        "predict_proba": "SELECT property_id, CAST(4 AS INT) AS tiers, true AS valid FROM newcomers",
        "score_batch": "SELECT property_id, true AS valid FROM newcomers",
        "linear_probe": "SELECT vec_id, label, true AS valid FROM embeddings",
        "text_classifier": "SELECT doc_id, true AS valid FROM documents",
        "leaderboard": "SELECT unnest(['tabular', 'vectors', 'vectors+tabular', 'tabular+flags']) AS approach, true AS valid",
        "geo_sweep": "SELECT CAST(c AS INT) AS clusters, h AS hotspots, b AS balanced, true AS valid FROM (SELECT unnest([5, 10, 15, 20, 30]) AS c), (SELECT unnest([false, true]) AS h), (SELECT unnest([false, true]) AS b)",
        "fitted_ensemble": f"WITH {_QUOTAS} SELECT CAST(9 AS BIGINT) AS weights, CAST(9 AS BIGINT) AS scored, CAST(sum(quota) AS BIGINT) AS same, CAST(sum(quota) AS BIGINT) AS n FROM quotas",
        # schema
        "repair_schema": "SELECT id AS property_id, name AS description, borough AS neighbourhood_group, area AS neighbourhood, type AS room_type, min_nights AS minimum_nights, reviews AS number_of_reviews, lat AS latitude, lng AS longitude, extra_col FROM raw",
        "map_unknown_columns": "SELECT id AS property_id, name AS description, area AS neighbourhood, extra_col, type AS room_type FROM raw",
        "add_default_columns": "SELECT property_id, description, latitude, longitude, 1e0 AS minimum_nights, 0e0 AS number_of_reviews, 1e0 AS calculated_host_listings_count, 180e0 AS availability_365, 'Manhattan' AS neighbourhood_group, 'Unknown' AS neighbourhood, 'Entire home/apt' AS room_type FROM listings",
        "coerce_numeric": f"SELECT id, coalesce({_num('min_nights')}, 1) AS minimum_nights, coalesce({_num('reviews')}, 0) AS number_of_reviews, coalesce({_num('lat')}, 40.7128) AS latitude FROM raw",
        "fill_categorical": "SELECT property_id, coalesce(neighbourhood_group, 'Manhattan') AS neighbourhood_group, neighbourhood, coalesce(room_type, 'Entire home/apt') AS room_type FROM listings",
        "fill_description": "SELECT property_id, coalesce(description, '') AS description FROM listings",
        "feature_projection": "SELECT * EXCLUDE (property_id, price_tier) FROM listings",
        "clean_listings": f"WITH {_CLEAN} SELECT * FROM cleaned",
        # language and gaps
        "non_english_flag": f"SELECT doc_id, {_FOREIGN.format(t='text')} AS non_english FROM documents",
        "needs_translation": f"SELECT property_id, description FROM listings WHERE {_FOREIGN.format(t='description')}",
        "apply_translations": "SELECT l.property_id, coalesce(t.translated, l.description) AS description FROM listings l LEFT JOIN translations t USING (property_id)",
        "missing_columns": f"""SELECT property_id, concat_ws(',', CASE WHEN {_GAP.format(c='neighbourhood_group')} THEN 'neighbourhood_group' END,
            CASE WHEN {_GAP.format(c='neighbourhood')} THEN 'neighbourhood' END, CASE WHEN {_GAP.format(c='room_type')} THEN 'room_type' END) AS missing FROM listings""",
        "infer_from_text": f"""SELECT property_id,
            CASE WHEN {_GAP.format(c='neighbourhood_group')} THEN coalesce({_mention('description', 'Manhattan', 'Brooklyn', 'Queens', 'Bronx', 'Staten Island')}, neighbourhood_group) ELSE neighbourhood_group END AS neighbourhood_group,
            CASE WHEN {_GAP.format(c='room_type')} THEN coalesce({_mention('description', 'Entire home/apt', 'Private room', 'Shared room')}, room_type) ELSE room_type END AS room_type FROM listings""",
        "apply_inferences": "SELECT l.property_id, coalesce(i.col_value, l.neighbourhood) AS neighbourhood, l.price_tier FROM listings l LEFT JOIN inferences i ON i.property_id = l.property_id AND i.col_name = 'neighbourhood'",
        # text
        "safe_int": f"SELECT id, {_int('min_nights')} AS nights, {_int('reviews')} AS reviews, {_int('lat')} AS lat, {_int('lng')} AS lng FROM raw",
        "phrase_min_nights": f"WITH v AS (SELECT id, {_int('min_nights')} AS n FROM raw) SELECT id, {_nights('n')} AS phrase FROM v",
        "phrase_reviews": f"WITH v AS (SELECT id, {_int('reviews')} AS n FROM raw) SELECT id, {_reviews('n')} AS phrase FROM v",
        "phrase_availability": f"SELECT property_id, {_availability(n['n_avail'])} AS phrase FROM listings",
        "phrase_availability_reviews": f"SELECT property_id, {_availability(n['n_avail'], n['n_reviews'])} AS phrase FROM listings",
        "phrase_host": f"SELECT property_id, {_host(n['n_host'])} AS phrase FROM listings",
        "qual_room_type": f"SELECT property_id, {_w_room('room_type')} AS phrase FROM newcomers UNION ALL SELECT property_id, {_w_room('room_type')} FROM listings",
        "qual_reviews": f"WITH v AS (SELECT id, {_int('reviews')} AS n FROM raw) SELECT id, {_w_reviews('n')} AS phrase FROM v",
        "qual_host": f"SELECT property_id, {_w_host(n['n_host'])} AS phrase FROM listings",
        "qual_availability": f"WITH m AS (SELECT median(availability_365) AS med FROM listings) SELECT property_id, {_w_availability(n['n_avail'], 'med')} AS phrase FROM listings, m",
        "qual_min_nights": f"WITH v AS (SELECT id, {_int('min_nights')} AS n FROM raw) SELECT id, {_w_nights('n')} AS phrase FROM v",
        "training_medians": "SELECT CAST(median(number_of_reviews) AS DOUBLE) AS number_of_reviews, CAST(median(calculated_host_listings_count) AS DOUBLE) AS calculated_host_listings_count, CAST(median(availability_365) AS DOUBLE) AS availability_365, CAST(median(minimum_nights) AS DOUBLE) AS minimum_nights FROM listings",
        "row_text_full": f"""WITH {_LABELLED} SELECT property_id, {_row_text('trim(description)', _place('located in ', ', '), 'geo_label', 'lower(trim(room_type))',
            _nights(n['n_nights']), _reviews(n['n_reviews']), _host(n['n_host']), _availability(n['n_avail'], n['n_reviews']))} AS text FROM assigned JOIN area USING (cluster)""",
        "row_text_serving": f"""WITH {_LABELLED} SELECT property_id, {_row_text('trim(description)', _place('located in ', ', '), 'geo_label', 'lower(trim(room_type))',
            _nights(n['n_nights']), _reviews(n['n_reviews']), _availability(n['n_avail']))} AS text FROM assigned JOIN area USING (cluster)""",
        "row_text_plain": f"""SELECT property_id, {_row_text('trim(description)', _place('located in ', ', '), 'lower(trim(room_type))',
            _nights(n['n_nights']), _reviews(n['n_reviews']), _host(n['n_host']), _availability(n['n_avail']))} AS text FROM listings""",
        "row_text_qualitative": f"""SELECT property_id, {_row_text('trim(description)', "'This listing offers ' || nullif(" + _w_room('room_type') + ", '')",
            _place('located in the ', ' neighbourhood of '), _w_host(n['n_host']), _w_reviews(n['n_reviews']), _w_availability(n['n_avail']), _w_nights(n['n_nights']))} AS text FROM listings""",
        "area_phrase": f"WITH {_LABELLED} SELECT property_id, 'located in a ' || geo_label AS phrase FROM assigned JOIN area USING (cluster)",
        "text_flags": f"SELECT property_id, {_flags('description')} FROM listings",
        "text_flags_documents": f"SELECT doc_id, {_flags('text')} FROM documents",
        "parse_flag_json": f"""WITH body AS (SELECT property_id, nullif(regexp_extract(response, '(?s)\\{{.*\\}}'), '') AS b FROM responses),
            parsed AS (SELECT property_id, CASE WHEN json_valid(b) THEN CAST(b AS JSON) END AS j FROM body)
            SELECT property_id, {_JSON_FLAGS} FROM parsed""",
        "parse_tier": "SELECT property_id, coalesce(CAST(nullif(regexp_extract(trim(response), '[0-3]'), '') AS INT), 1) AS price_tier FROM responses",
        "few_shot_block": f"WITH {_BLOCK} SELECT block FROM example_block",
        "render_prompts": f"""WITH {_BLOCK} SELECT property_id,
            'Assign a short-term rental listing to one of four price tiers: 0 = Budget, 1 = Standard, 2 = Premium, 3 = Ultra-Luxury.' || chr(10) || chr(10) || 'Examples:' || chr(10)
            || (SELECT block FROM example_block) || chr(10) || chr(10) || 'Listing:' || chr(10)
            || replace('  ' || {_EXAMPLE}, ' | ', chr(10) || '  ') || chr(10) || chr(10) || 'Answer with one digit from 0 to 3.' AS prompt FROM newcomers""",
        # geography
        "hotspot_distances": f"SELECT property_id, {distances} FROM listings",
        "nearest_centre": f"WITH {_ASSIGNED} SELECT property_id, CAST(cluster AS INT) AS cluster FROM assigned",
        "cluster_summary": f"""WITH {_ASSIGNED}, g AS (SELECT cluster, avg(price_tier) AS m, count(*) AS n, avg(latitude) AS la, avg(longitude) AS lo FROM assigned GROUP BY cluster)
            SELECT CAST(c.cluster AS INT) AS cluster, round(m, 6) AS mean_tier, coalesce(n, 0) AS n, round(la, 6) AS mean_lat, round(lo, 6) AS mean_lon, {_LABEL} AS geo_label
            FROM centres c LEFT JOIN g ON g.cluster = c.cluster""",
        "tier_label": f"WITH g AS (SELECT neighbourhood, number_of_reviews, avg(price_tier) AS m FROM listings GROUP BY ALL) SELECT neighbourhood, number_of_reviews, {_LABEL} AS geo_label FROM g",
        "geo_label": f"WITH {_LABELLED} SELECT property_id, geo_label FROM assigned JOIN area USING (cluster)",
        "knn_geo_tier": f"WITH {_knn('newcomers', 'located', 'true')} SELECT property_id, geo_tier FROM knn",
        "knn_geo_tier_oof": f"WITH {_OOF} SELECT property_id, geo_tier FROM knn",
        "location_prefix": f"WITH {_knn('newcomers', 'located', 'true')} SELECT property_id, 'location_tier_' || geo_tier || ' ' || coalesce(description, '') AS combined FROM knn JOIN newcomers USING (property_id)",
        "leakage_rate": f"WITH {_OOF} SELECT round(avg(CAST(geo_tier = price_tier AS INT)), 6) AS agreement FROM knn JOIN located USING (property_id)",
        "geo_tier_counts": f"WITH {_OOF} SELECT geo_tier, count(*) AS n FROM knn GROUP BY geo_tier",
        # sampling
        "stratified_split": f"""WITH {_QUOTAS}, r AS (SELECT property_id, price_tier, row_number() OVER (PARTITION BY price_tier ORDER BY {_hash(42)}, property_id) AS rn FROM listings)
            SELECT property_id, price_tier, rn <= quota AS is_validation FROM r JOIN quotas USING (price_tier)""",
        "per_class_sample": f"SELECT property_id, price_tier FROM (SELECT *, row_number() OVER (PARTITION BY price_tier ORDER BY {_hash(42)}, property_id) AS rn FROM partly WHERE price_tier IS NOT NULL) WHERE rn <= 3",
        "kfold": f"WITH {_FOLDS} SELECT property_id, fold FROM folds",
        "subset_n": f"SELECT property_id FROM listings ORDER BY {_hash(42)}, property_id LIMIT 50",
        # features
        "one_hot": f"SELECT n.property_id, {hot_columns('neighbourhood_group', boroughs, 5)}, {hot_columns('room_type', rooms, 3)} FROM newcomers n",
        "ordinal_code": """WITH codes AS (SELECT neighbourhood, row_number() OVER (ORDER BY neighbourhood) - 1 AS code FROM (SELECT DISTINCT neighbourhood FROM listings))
            SELECT n.property_id, n.neighbourhood, CAST(coalesce(code, -1) AS BIGINT) AS code FROM newcomers n LEFT JOIN codes USING (neighbourhood)""",
        "assemble_features": f"""WITH codes AS (SELECT neighbourhood, row_number() OVER (ORDER BY neighbourhood) - 1 AS code FROM (SELECT DISTINCT neighbourhood FROM listings)),
            f AS (SELECT property_id, {_flags('description')} FROM listings),
            widths AS (SELECT count(DISTINCT coalesce(neighbourhood_group, 'Manhattan')) + count(DISTINCT coalesce(room_type, 'Entire home/apt')) AS w FROM listings)
            SELECT property_id, CAST(w + 6 + 1 + 6 AS INT) AS width,
              round(minimum_nights + 2 * number_of_reviews + 3 * calculated_host_listings_count + 4 * availability_365 + 5 * latitude + 6 * longitude
              + 7 * code + 8 + (SELECT count(DISTINCT coalesce(neighbourhood_group, 'Manhattan')) FROM listings o WHERE coalesce(o.neighbourhood_group, 'Manhattan') < coalesce(listings.neighbourhood_group, 'Manhattan'))
              + 8 + (SELECT count(DISTINCT coalesce(neighbourhood_group, 'Manhattan')) FROM listings)
              + (SELECT count(DISTINCT coalesce(room_type, 'Entire home/apt')) FROM listings o WHERE coalesce(o.room_type, 'Entire home/apt') < coalesce(listings.room_type, 'Entire home/apt'))
              + (w + 8) * has_luxury + (w + 9) * has_view + (w + 10) * has_outdoor + (w + 11) * is_shared + (w + 12) * needs_work + (w + 13) * has_amenities, 6) AS by_place, round(minimum_nights + number_of_reviews + calculated_host_listings_count + availability_365
              + latitude + longitude + code + 2 + has_luxury + has_view + has_outdoor + is_shared + needs_work + has_amenities, 6) AS total
            FROM listings JOIN codes USING (neighbourhood) JOIN f USING (property_id), widths""",
        "text_vectors": "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS BIGINT) AS words, CAST(4096 AS INT) AS width FROM documents",
        "predict_proba_sums": "SELECT property_id, CAST(4 AS INT) AS tiers, 1e0 AS total, true AS none_negative FROM newcomers",
        "class_weights": "WITH c AS (SELECT price_tier, count(*) AS n FROM listings GROUP BY price_tier) SELECT price_tier, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 9) AS weight FROM c",
        "class_weights_quality": "WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) SELECT quality, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 9) AS weight FROM c",
        "sample_weights": "WITH c AS (SELECT price_tier, count(*) AS n FROM listings GROUP BY price_tier) SELECT property_id, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 9) AS weight FROM listings JOIN c USING (price_tier)",
        # ensembling
        "scores_to_proba": "SELECT property_id, " + ", ".join(f"CASE WHEN p{i} > 0.2 THEN p{i} ELSE 0 END AS p{i}" for i in range(4)) + " FROM first_scores",
        "softmax": """WITH z AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
            e AS (SELECT vec_id, [exp(x - list_max(v)) FOR x IN v] AS e FROM z)
            SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INT) AS top, round(list_max(e) / list_sum(e), 9) AS p_top, round(list_min(e) / list_sum(e), 9) AS p_low FROM e""",
        "argmax": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS top FROM embeddings",
        "soft_vote": """SELECT a.property_id, round(0.6 * a.p0 + 0.4 * b.p0, 9) AS p0, round(0.6 * a.p1 + 0.4 * b.p1, 9) AS p1, round(0.6 * a.p2 + 0.4 * b.p2, 9) AS p2,
            round(0.6 * a.p3 + 0.4 * b.p3, 9) AS p3 FROM first_scores a JOIN second_scores b USING (property_id)""",
        "soft_vote_fallback": f"""WITH {_VOTE_ROWS}, m AS (SELECT property_id, CASE WHEN vb IS NULL THEN va ELSE [0.5e0 * va[i] + 0.5e0 * vb[i] FOR i IN range(1, 5)] END AS v FROM paired)
            SELECT property_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS price_tier FROM m""",
        "weight_sweep": f"WITH {_voted('(1e-1), (2e-1), (3e-1), (4e-1), (5e-1), (6e-1), (7e-1), (8e-1), (9e-1)')} SELECT weight, round(macro_f1, 6) AS macro_f1 FROM f1s",
        "ensemble_compare": f"WITH {_voted('(1e0), (0e0), (5e-1)')} SELECT CASE weight WHEN 1 THEN 'first' WHEN 0 THEN 'second' ELSE 'ensemble' END AS scorer, round(macro_f1, 6) AS macro_f1 FROM f1s",
        # evaluation
        "eval_join": "SELECT p.property_id, p.price_tier, l.price_tier AS true_tier, count(*) AS n FROM predictions p JOIN partly l ON p.property_id = l.property_id WHERE p.price_tier IS NOT NULL AND l.price_tier IS NOT NULL GROUP BY ALL",
        "eval_empty": "SELECT CAST(NULL AS DOUBLE) AS macro_f1, 0::BIGINT AS n_evaluated, CAST(NULL AS VARCHAR) AS report, 'No matching property_id between predictions and labels.' AS error",
        "class_report": f"WITH {_evaluated('predictions', 'partly')}, {_REPORT} SELECT CAST(position AS INT) AS position, name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM report",
        "macro_f1": f"WITH {_evaluated('predictions', 'partly')} SELECT round(avg(f1), 6) AS macro_f1 FROM measured",
        "evaluation_record": f"WITH {_evaluated('predictions', 'partly')}, {_REPORT}, {_RECORD} SELECT * FROM record",
        "evaluate_tables": f"""WITH answers AS (SELECT property_id, coalesce(CAST(nullif(regexp_extract(trim(response), '[0-3]'), '') AS INT), 1) AS price_tier FROM responses),
            {_evaluated('answers', 'partly')}, {_REPORT}, {_RECORD} SELECT * FROM record""",
        "tier_distribution": """WITH names(price_tier, tier_name) AS (VALUES (0, 'Budget'), (1, 'Standard'), (2, 'Premium'), (3, 'Ultra-Luxury'))
            SELECT price_tier, tier_name, (SELECT count(*) FROM predictions p WHERE p.price_tier = names.price_tier) AS n FROM names""",
        "sweep_top5": f"""WITH {_voted('(1e-1), (2e-1), (3e-1), (4e-1), (5e-1), (6e-1), (7e-1), (8e-1), (9e-1)')}
            SELECT round(macro_f1, 6) AS macro_f1, CAST(round(weight * 10) AS INT) AS clusters, weight > 0.55 AS hotspots, weight < 0.35 AS balanced FROM f1s
            ORDER BY f1s.macro_f1 DESC, clusters DESC, hotspots DESC, balanced DESC LIMIT 5""",
        "run_batch": f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER ({_FOREIGN.format(t="coalesce(description, '')")}) AS f,
              count(*) FILTER ({_GAP.format(c='neighbourhood')}) AS g FROM listings)
            SELECT * FROM (VALUES ('schema', 'columns', '11'), ('schema', 'aliases_resolved', ''), ('schema', 'unknown_mapped', ''),
              ('schema', 'unknown_kept', ''), ('schema', 'defaults_applied', ''), ('predict', 'Budget', 'counted'), ('predict', 'Standard', 'counted'),
              ('predict', 'Premium', 'counted'), ('predict', 'Ultra-Luxury', 'counted'), ('evaluate', 'macro_f1', 'true'), ('evaluate', 'report', 'true')) v(step, metric, value)
            UNION ALL SELECT 'schema', 'rows', CAST(n AS VARCHAR) FROM c UNION ALL SELECT 'translate', 'non_english_rows', CAST(f AS VARCHAR) FROM c
            UNION ALL SELECT 'infer', 'rows_with_gaps', CAST(g AS VARCHAR) FROM c
            UNION ALL SELECT 'infer', 'columns_with_gaps', CASE WHEN g > 0 THEN 'neighbourhood' ELSE '' END FROM c
            UNION ALL SELECT 'predict', 'predictions', CAST(n AS VARCHAR) FROM c UNION ALL SELECT 'predict', 'sum of tiers', CAST(n AS VARCHAR) FROM c
            UNION ALL SELECT 'evaluate', 'n_evaluated', CAST(n AS VARCHAR) FROM c""",
        "run_report": f"""WITH {_CLEAN},
            c AS (SELECT count(*) AS n, count(*) FILTER ({_FOREIGN.format(t='description')}) AS f, count(*) FILTER (neighbourhood = 'Unknown') AS g FROM cleaned)
            SELECT * FROM (VALUES ('schema', 'columns', '10'),
              ('schema', 'aliases_resolved', 'id -> property_id, name -> description, borough -> neighbourhood_group, area -> neighbourhood, type -> room_type, min_nights -> minimum_nights, reviews -> number_of_reviews, lat -> latitude, lng -> longitude'),
              ('schema', 'unknown_mapped', ''), ('schema', 'unknown_kept', 'extra_col'),
              ('schema', 'defaults_applied', 'calculated_host_listings_count, availability_365')) v(step, metric, value)
            UNION ALL SELECT 'schema', 'rows', CAST(n AS VARCHAR) FROM c UNION ALL SELECT 'translate', 'non_english_rows', CAST(f AS VARCHAR) FROM c
            UNION ALL SELECT 'infer', 'rows_with_gaps', CAST(g AS VARCHAR) FROM c
            UNION ALL SELECT 'infer', 'columns_with_gaps', CASE WHEN g > 0 THEN 'neighbourhood' ELSE '' END FROM c""",
    }
    return {name: with_views(text) for name, text in sql.items()}
