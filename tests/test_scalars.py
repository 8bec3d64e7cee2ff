"""Numbers from text and every cut point of the phrases: below, at and above, null, NaN, text."""

import pytest
from pyspark.sql import functions as F

from lodgetier.functions import phrases as p
from lodgetier.functions.answers import first_mentioned, non_english, parsed_flags, parsed_tier, text_flags
from lodgetier.functions.scalars import identifier, number, safe_int, stripped
from lodgetier.functions.vote import argmax, scores_to_vector, soft_vote, softmax


def values(spark, inputs, function, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_number(spark):
    texts = ["1", " 2 ", "+5", ".5", "5.", "1e2", "-3", "1d", "1f", "1_000", "0x10", "1,000", "nan", "inf", "", None, "abc"]
    expected = [1, 2, 5, 0.5, 5, 100, -3] + [None] * 10
    assert values(spark, texts, number) == expected


def test_safe_int_truncates(spark):
    texts = ["2.9", "-2.9", "1e12", "1e30", "x", None]
    assert values(spark, texts, safe_int) == [2, -2, 10**12, None, None, None]
    assert values(spark, [float("nan"), float("inf"), 7.5], safe_int, "double") == [None, None, 7]


def test_identifier_keeps_every_digit(spark):
    big = 9_007_199_254_740_993
    assert values(spark, [str(big), "12.0", " 7 ", "x"], identifier) == [big, 12, 7, None]


def test_stripped(spark):
    assert values(spark, ["\t a b  \n", "  ", None], stripped) == ["a b", None, None]


@pytest.mark.parametrize(
    "function, cases",
    [
        (
            p.nights_phrase,
            {
                -1: "flexible stay (1 night minimum)",
                1: "flexible stay (1 night minimum)",
                2: "short stay (2 night minimum)",
                3: "short stay (3 night minimum)",
                4: "weekly stay (4 night minimum)",
                7: "weekly stay (7 night minimum)",
                8: "extended stay (8 night minimum)",
                30: "extended stay (30 night minimum)",
                31: "long-term stay (31 night minimum)",
            },
        ),
        (
            p.reviews_phrase,
            {
                0: "new listing, no reviews yet",
                -1: "very few reviews (-1)",
                5: "very few reviews (5)",
                6: "few reviews (6)",
                20: "few reviews (20)",
                21: "several reviews (21)",
                50: "several reviews (50)",
                51: "many reviews (51)",
                100: "many reviews (100)",
                101: "highly reviewed (101 reviews)",
            },
        ),
        (
            p.availability_phrase,
            {
                0: "rarely available, almost always booked",
                30: "rarely available, almost always booked",
                31: "occasionally available (31 days/year)",
                90: "occasionally available (90 days/year)",
                91: "often available (91 days/year)",
                180: "often available (180 days/year)",
                181: "frequently available (181 days/year)",
            },
        ),
        (
            p.host_phrase,
            {
                0: "small host (0 listings)",
                1: "individual host",
                5: "small host (5 listings)",
                6: "professional host (6 listings)",
                20: "professional host (20 listings)",
                21: "large property manager (21 listings)",
            },
        ),
        (
            p.worded_reviews,
            {
                0: "a brand-new listing with no reviews yet",
                4: "a lightly reviewed listing",
                5: "a moderately reviewed listing",
                19: "a moderately reviewed listing",
                20: "a very well-reviewed listing",
            },
        ),
        (
            p.worded_host,
            {
                0: "run by a small host with a handful of listings",
                1: "run by an individual host who lists only this one place",
                3: "run by a small host with a handful of listings",
                4: "run by a professional host managing many listings",
                15: "run by a professional host managing many listings",
                16: "run by a large property-management operation",
            },
        ),
        (
            p.worded_availability,
            {
                0: "with a fully blocked calendar this year",
                37: "with a tighter-than-typical calendar",
                38: "with a moderately open calendar",
                74: "with a moderately open calendar",
                75: "with a much more open calendar than usual",
            },
        ),
        (
            p.worded_nights,
            {
                1: "bookable for a single night",
                2: "open to short stays",
                30: "open to short stays",
                31: "geared to long-term stays",
            },
        ),
    ],
)
def test_cut_points(spark, function, cases):
    assert values(spark, list(cases), function, "bigint") == list(cases.values())
    assert values(spark, [None, "text", "nan"], function) == [None, None, None]
    assert values(spark, [float("nan")], function, "double") == [None]


def test_availability_of_new_listings(spark):
    df = spark.createDataFrame([(30, 0), (30, 1), (31, 0), (5, None)], "a int, r int")
    found = [r[0] for r in df.select(p.availability_phrase(F.col("a"), F.col("r"))).collect()]
    assert found == [
        "new listing, availability unknown",
        "rarely available, almost always booked",
        "occasionally available (31 days/year)",
        "rarely available, almost always booked",
    ]


def test_worded_room_type(spark):
    found = values(spark, [" Private Room ", "Boat", None], p.worded_room_type)
    assert found == ["a private room within a shared home", "boat", ""]


def test_row_text_parts_are_optional(spark):
    schema = "description string, neighbourhood string, neighbourhood_group string, minimum_nights string"
    rows = [("  Nice ", "Soho", "Manhattan", "2"), (None, "Soho", None, "x"), ("", None, "Bronx", None)]
    df = spark.createDataFrame(rows, schema)
    found = [r[0] for r in df.select(p.row_text(df, "full")).collect()]
    assert found == ["Nice. located in Soho, Manhattan. short stay (2 night minimum).", ".", "located in Bronx."]


def test_non_english(spark):
    texts = ["", None, "plain", "é" * 3 + "a" * 17, "é" * 4 + "a" * 16, "\U0001f600" * 2 + "abc"]
    assert values(spark, texts, non_english) == [False, False, False, False, True, True]


def test_flags_need_whole_words(spark):
    flags = text_flags(F.col("v"))
    texts = ["Great reviews", "River VIEW!", "poolside", "a pool", None, "great views, two pools"]
    assert values(spark, texts, lambda _: flags["has_view"]) == [0, 1, 0, 0, 0, 1]
    assert values(spark, texts, lambda _: flags["has_amenities"]) == [0, 0, 0, 1, 0, 1]


def test_first_mentioned(spark):
    texts = ["From Queens to Manhattan", "STATEN ISLAND ferry", "nowhere", None, "near Queensboro bridge, Brooklyn"]
    found = values(spark, texts, lambda c: first_mentioned(c, "neighbourhood_group"))
    assert found == ["Queens", "Staten Island", None, None, "Brooklyn"]


def test_parsed_flags(spark):
    cases = {
        'x {"has_luxury": true} y': 1,
        '{"has_luxury": false}': 0,
        '{"has_luxury": "false"}': 1,
        '{"has_luxury": ""}': 0,
        '{"has_luxury": 0}': 0,
        '{"has_luxury": 0.5}': 1,
        '{"has_luxury": null}': 0,
        '{"has_luxury": []}': 0,
        '{"has_luxury": [0]}': 1,
        '{"has_luxury": {}}': 0,
        "{broken": 0,
        "{broken}": 0,
        'two {"has_luxury": true} and }': 0,
        '{"has_luxury": true}, {}': 0,
        '{"has_luxury": true}] {}': 0,
        '{"has_luxury": true}} {}': 0,
        '{"has_luxury": true}, "b": {}': 0,
        '{"a": {"b": "}"}, "has_luxury": true}': 1,
        "no json": 0,
        None: 0,
        '{\n"has_luxury":\ntrue}': 1,
    }
    found = values(spark, list(cases), lambda c: parsed_flags(c)["has_luxury"])
    assert dict(zip(cases, found)) == cases


def test_parsed_tier(spark):
    assert values(spark, ["Tier 2", "9", "93", "", None, "-1"], parsed_tier) == [2, 1, 3, 1, 1, 1]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 0.0], [0.0, 1.0, 0.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(
        argmax(F.col("a")).alias("first_on_ties"),
        softmax(F.col("a")).alias("shares"),
        soft_vote(F.col("a"), F.col("b"), 0.25).alias("mixed"),
    ).first()
    assert row.first_on_ties == 1
    assert sum(row.shares) == pytest.approx(1) and row.shares[1] == row.shares[2] > row.shares[0]
    assert row.mixed == [0.25, 1.25, 0.5, 0.0]
    assert df.select(softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0] == [0.5, 0.5]


def test_scores_to_vector(spark):
    rows = [([("LABEL_2", 0.7), ("x_y_0", 0.3)],), ([],), ([("LABEL", 0.4), ("L_9", 0.6)],), (None,)]
    df = spark.createDataFrame(rows, "s array<struct<label:string,score:double>>")
    found = [r[0] for r in df.select(scores_to_vector(F.col("s"))).collect()]
    assert found == [[0.3, 0.0, 0.7, 0.0], [0.0] * 4, [0.0] * 4, None]


def test_exact_medians(spark):
    import random
    import statistics

    from lodgetier.operators.features import exact_medians

    pick = random.Random(2)
    for n in (1, 2, 7, 500):
        rows = [(pick.randrange(5), pick.random(), 3 if i % 3 else None, None) for i in range(n)]
        found = exact_medians(spark.createDataFrame(rows, "a int, b double, c int, d int"), ["a", "b", "c", "d"]).first()
        for i, name in enumerate("abcd"):
            values = [r[i] for r in rows if r[i] is not None]
            assert found[name] == (statistics.median(values) if values else None)
    assert exact_medians(spark.createDataFrame([], "a int"), ["a"]).first().a is None
