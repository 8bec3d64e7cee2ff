"""Listing columns as phrases, and whole listings as one sentence per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetier import constants as k
from lodgetier.functions.scalars import banded, safe_int, stripped


def nights_phrase(value: Column) -> Column:
    return banded(safe_int(value), k.NIGHTS_PHRASES)


def reviews_phrase(value: Column) -> Column:
    n = safe_int(value)
    return F.when(n == 0, F.lit(k.NO_REVIEWS_PHRASE)).otherwise(banded(n, k.REVIEWS_PHRASES))


def availability_phrase(value: Column, reviews: Column | None = None) -> Column:
    """With `reviews`, a rarely available listing without any is called new instead."""
    n = safe_int(value)
    phrase = banded(n, k.AVAILABILITY_PHRASES)
    if reviews is None:
        return phrase
    unseen = (n <= k.RARELY_AVAILABLE_UP_TO) & (safe_int(reviews) == 0)
    return F.when(unseen, F.lit(k.NEW_LISTING_AVAILABILITY_PHRASE)).otherwise(phrase)


def host_phrase(value: Column) -> Column:
    n = safe_int(value)
    return F.when(n == 1, F.lit(k.ONE_LISTING_HOST_PHRASE)).otherwise(banded(n, k.HOST_PHRASES))


def worded_room_type(value: Column) -> Column:
    """Known room types in words; any other passes through in lower case."""
    plain = F.coalesce(F.lower(stripped(value)), F.lit(""))
    wording = F.create_map(*[F.lit(x) for pair in k.ROOM_TYPE_WORDING.items() for x in pair])
    return F.coalesce(F.try_element_at(wording, plain), plain)


def worded_reviews(value: Column, median: Column | float = k.MEDIANS["number_of_reviews"]) -> Column:
    n, middle = safe_int(value), _column(median)
    light, moderate, well = (F.lit(x) for x in k.WORDED_REVIEWS)
    return (
        F.when(n == 0, F.lit(k.WORDED_NO_REVIEWS))
        .when(n >= 4 * middle, well)
        .when(n >= middle, moderate)
        .when(n.isNotNull(), light)
    )


def worded_host(value: Column) -> Column:
    n = safe_int(value)
    return F.when(n == 1, F.lit(k.WORDED_ONE_LISTING_HOST)).otherwise(banded(n, k.WORDED_HOST))


def worded_availability(value: Column, median: Column | float = k.MEDIANS["availability_365"]) -> Column:
    n, middle = safe_int(value), _column(median)
    tight, moderate, wide = (F.lit(x) for x in k.WORDED_AVAILABILITY)
    return (
        F.when(n == 0, F.lit(k.WORDED_NO_AVAILABILITY))
        .when(n <= middle, tight)
        .when(n <= 2 * middle, moderate)
        .when(n.isNotNull(), wide)
    )


def worded_nights(value: Column) -> Column:
    return banded(safe_int(value), k.WORDED_NIGHTS)


def area_phrase(geo_label: Column) -> Column:
    """"located in a <label>", or "" when there is no label."""
    return F.coalesce(F.concat(F.lit("located in a "), geo_label), F.lit(""))


def location_prefix(geo_tier: Column, text: Column) -> Column:
    """The area's tier as a leading token, then the text."""
    return F.concat(F.lit("location_tier_"), geo_tier.cast("string"), F.lit(" "), F.coalesce(text, F.lit("")))


def _column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _get(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _place(df: DataFrame, start: str, between: str) -> Column:
    """Where a listing is; nothing without a borough."""
    inner, outer = stripped(_get(df, "neighbourhood")), stripped(_get(df, "neighbourhood_group"))
    return F.coalesce(
        F.concat(F.lit(start), inner, F.lit(between), outer), F.concat(F.lit("located in "), outer)
    )


def _sentence(*parts: Column) -> Column:
    present = [F.nullif(part, F.lit("")) for part in parts]
    return F.concat(F.concat_ws(". ", *present), F.lit("."))


def row_text(df: DataFrame, dialect: str = "full", medians: Mapping[str, float] = k.MEDIANS) -> Column:
    """The whole listing as one sentence; absent columns and empty values leave no part behind.

    full         description, place, area label, room type, nights, reviews, host, availability
    serving      as full, without the host, availability without regard to reviews
    plain        as full, without the area label, availability without regard to reviews
    worded       description, room type, place, host, reviews, availability, nights; no figures
    """
    text, area = stripped(_get(df, k.TEXT)), stripped(_get(df, "geo_label"))
    nights, reviews = _get(df, "minimum_nights"), _get(df, "number_of_reviews")
    hosted, available = _get(df, "calculated_host_listings_count"), _get(df, "availability_365")
    if dialect == "worded":
        room = F.nullif(worded_room_type(_get(df, "room_type")), F.lit(""))
        return _sentence(
            text,
            F.concat(F.lit("This listing offers "), room),
            _place(df, "located in the ", " neighbourhood of "),
            worded_host(hosted),
            worded_reviews(reviews, medians["number_of_reviews"]),
            worded_availability(available, medians["availability_365"]),
            worded_nights(nights),
        )
    opening = [text, _place(df, "located in ", ", ")]
    room = F.lower(stripped(_get(df, "room_type")))
    figures = [room, nights_phrase(nights), reviews_phrase(reviews)]
    if dialect == "full":
        return _sentence(*opening, area, *figures, host_phrase(hosted), availability_phrase(available, reviews))
    if dialect == "serving":
        return _sentence(*opening, area, *figures, availability_phrase(available))
    if dialect == "plain":
        return _sentence(*opening, *figures, host_phrase(hosted), availability_phrase(available))
    raise ValueError(f"unknown dialect {dialect!r}")
