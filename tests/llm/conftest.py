import random

import pytest
from llm_helpers import DOCS, prose


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, white and very long texts, ties, repeated rows, a clashing extra column."""
    long = " ".join(prose(random.Random(1), 60_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", "s", 4),
        (4, "one", "en", "s", 3),
        (5, "same text here, and a few words more", "en", "s", 1),
        (6, "same text here, and a few words more", None, "s", 1),
        (6, "same text here, and a few words more", None, "s", 1),
        (7, long, "en", "s", len(long)),
        (8, long, "en", None, len(long)),
        (None, "a text without an id", "en", "s", 1),
        (9, "1234 5678 !!", "en", "s", 12),
        (10, "a" * 50_000, "en", "s", 50_000),
    ]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS id", "2 AS key", "'x' AS n", "3L AS component")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)

