"""Names, defaults, word lists and phrases that results depend on.

Everything in this module is a plain value. Logic lives elsewhere.
"""

ID = "property_id"
TEXT = "description"
TARGET = "price_tier"
SEED = 42
VALIDATION_SHARE = 0.1

# The four tiers and their names.
TIERS = (0, 1, 2, 3)
TIER_NAMES = ("Budget", "Standard", "Premium", "Ultra-Luxury")

# Canonical columns with their defaults.
NUMERIC_DEFAULTS = {
    "minimum_nights": 1.0,
    "number_of_reviews": 0.0,
    "calculated_host_listings_count": 1.0,
    "availability_365": 180.0,
    "latitude": 40.7128,
    "longitude": -74.0060,
}
CATEGORY_DEFAULTS = {
    "neighbourhood_group": "Manhattan",
    "neighbourhood": "Unknown",
    "room_type": "Entire home/apt",
}
CANONICAL = (ID, TEXT, *CATEGORY_DEFAULTS, *NUMERIC_DEFAULTS)

# Other names each canonical column may arrive under, in order of preference.
ALIASES = {
    "property_id": ("id", "listing_id"),
    "description": ("name", "title", "summary", "neighborhood_overview"),
    "neighbourhood_group": ("borough", "region"),
    "neighbourhood": ("area", "location"),
    "room_type": ("type", "listing_type"),
    "minimum_nights": ("min_nights", "minimum_stay", "min_nights_required"),
    "number_of_reviews": ("reviews", "num_reviews"),
    "calculated_host_listings_count": ("host_listings", "host_listings_count"),
    "availability_365": ("availability", "avail_365"),
    "latitude": ("lat",),
    "longitude": ("lng", "lon"),
}

# Texts that stand for a missing value in a CSV field (exact, untrimmed).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Number texts accepted by numeric coercion (no suffixes, hex, separators, nan).
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# White space removed from both ends of a text.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Columns that may be inferred, and the texts that count as missing there.
INFERABLE = ("neighbourhood_group", "neighbourhood", "room_type")
MISSING_TEXTS = ("", "Unknown", "nan")
VOCABULARY = {
    "neighbourhood_group": ("Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island"),
    "room_type": ("Entire home/apt", "Private room", "Shared room"),
}
NON_ASCII_SHARE = 0.15

# Words behind each yes/no text flag.
FLAG_WORDS = {
    "has_luxury": ("luxury", "penthouse", "marble", "doorman", "concierge", "high-end"),
    "has_view": ("view", "skyline", "park view", "river", "city view"),
    "has_outdoor": ("rooftop", "balcony", "terrace", "garden", "patio"),
    "is_shared": ("shared bathroom", "shared room", "hostel", "dormitory"),
    "needs_work": ("renovation", "repair", "fixer", "worn", "basic"),
    "has_amenities": ("pool", "gym", "spa", "elevator", "fireplace"),
}
FLAGS = tuple(FLAG_WORDS)

# Reference points, degrees (latitude, longitude).
HOTSPOTS = {
    "central_park": (40.7829, -73.9654),
    "tribeca": (40.7195, -74.0089),
    "upper_east_side": (40.7736, -73.9566),
    "midtown": (40.7549, -73.9840),
    "soho": (40.7233, -74.0030),
}
HOTSPOT_COLUMNS = tuple(f"dist_{name}" for name in HOTSPOTS)

# Fixed value: where listings without coordinates are taken to be.
CITY_CENTRE = (40.7128, -74.006)

# Mean tier from (inclusive), to (exclusive), area label.
AREA_LABELS = (
    (0.0, 0.75, "budget area"),
    (0.75, 1.5, "standard area"),
    (1.5, 2.25, "premium area"),
    (2.25, 3.0, "luxury district"),
)
AREA_LABEL_OTHERWISE = "luxury district"

# Phrases with figures. (upper bound inclusive, phrase); None is everything above.
NIGHTS_PHRASES = (
    (1, "flexible stay (1 night minimum)"),
    (3, "short stay ({n} night minimum)"),
    (7, "weekly stay ({n} night minimum)"),
    (30, "extended stay ({n} night minimum)"),
    (None, "long-term stay ({n} night minimum)"),
)
NO_REVIEWS_PHRASE = "new listing, no reviews yet"
REVIEWS_PHRASES = (
    (5, "very few reviews ({n})"),
    (20, "few reviews ({n})"),
    (50, "several reviews ({n})"),
    (100, "many reviews ({n})"),
    (None, "highly reviewed ({n} reviews)"),
)
RARELY_AVAILABLE_UP_TO = 30
AVAILABILITY_PHRASES = (
    (30, "rarely available, almost always booked"),
    (90, "occasionally available ({n} days/year)"),
    (180, "often available ({n} days/year)"),
    (None, "frequently available ({n} days/year)"),
)
NEW_LISTING_AVAILABILITY_PHRASE = "new listing, availability unknown"
ONE_LISTING_HOST_PHRASE = "individual host"
HOST_PHRASES = (
    (5, "small host ({n} listings)"),
    (20, "professional host ({n} listings)"),
    (None, "large property manager ({n} listings)"),
)

# Phrases without figures.
ROOM_TYPE_WORDING = {
    "entire home/apt": "an entire home or apartment, the whole private unit to themselves",
    "private room": "a private room within a shared home",
    "shared room": "a shared room, the most budget level of space",
}
WORDED_NO_REVIEWS = "a brand-new listing with no reviews yet"
WORDED_REVIEWS = (
    "a lightly reviewed listing",
    "a moderately reviewed listing",
    "a very well-reviewed listing",
)
WORDED_ONE_LISTING_HOST = "run by an individual host who lists only this one place"
WORDED_HOST = (
    (3, "run by a small host with a handful of listings"),
    (15, "run by a professional host managing many listings"),
    (None, "run by a large property-management operation"),
)
WORDED_NO_AVAILABILITY = "with a fully blocked calendar this year"
WORDED_AVAILABILITY = (
    "with a tighter-than-typical calendar",
    "with a moderately open calendar",
    "with a much more open calendar than usual",
)
WORDED_NIGHTS = (
    (1, "bookable for a single night"),
    (30, "open to short stays"),
    (None, "geared to long-term stays"),
)

# Medians the wording without figures is anchored on unless others are given.
MEDIANS = {
    "number_of_reviews": 5,
    "calculated_host_listings_count": 1,
    "availability_365": 37,
    "minimum_nights": 2,
}

# The parts of one worked example line, in order.
EXAMPLE_FIELDS = (
    ("Description", "description"),
    ("Neighbourhood group", "neighbourhood_group"),
    ("Neighbourhood", "neighbourhood"),
    ("Room type", "room_type"),
    ("Min nights", "minimum_nights"),
    ("Reviews", "number_of_reviews"),
    ("Availability", "availability_365"),
)
SHOTS_PER_TIER = 3

# Model features.
BASE_NUMERIC = (
    "minimum_nights", "number_of_reviews", "calculated_host_listings_count",
    "availability_365", "latitude", "longitude",
)
ONE_HOT = ("neighbourhood_group", "room_type")
ORDINAL = ("neighbourhood", "geo_label")

# Settings of the sweep, the vote and the neighbour search.
SWEEP_CLUSTERS = (5, 10, 15, 20, 30)
DEFAULT_CLUSTERS = 15
BEST_CLUSTERS = 5
CLUSTER_RESTARTS = 10
VOTE_WEIGHT = 0.5
VOTE_WEIGHTS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
NEIGHBOURS = 15
FOLDS = 5
