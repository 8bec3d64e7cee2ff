import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    """n words that look random, repeatable."""
    import random

    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + pick.choice(WORDS)[:3] for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = prose(9_000, 1)
    same = prose(120, 2)
    near = same.replace("alpha", "Alpha", 1)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "b", 4), (4, long, "de", None, 70_000),
        (5, same, "en", "a", 1), (6, same, "en", "a", 1), (6, same, "en", "a", 1), (7, near, "fr", "b", 1),
        (None, same, None, None, None), (None, None, None, None, None), (8, "word", "en", "ä", 4),
        (9, "two spaces  <|endoftext|> \U0001f600 é ", "es", "a", 9), (10, prose(300, 3), "en", "", 1),
        (11, "x", "en", "b", 1), (11, prose(90, 4), "en", "b", 1), (12, "so so " * 300, "en", "b", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def docs_schema():
    return DOCS


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with further columns named like those that the operators add."""
    from pyspark.sql import functions as F

    more = "size taken target start fp shard slot score kept predicted n_words part block gram span first last row times ids".split()
    return odd.select("*", *(F.lit("x").alias(c) for c in more))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def given(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
