import random

import pytest

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, kept string, label string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, extra columns with clashing names."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "word", "ending"]) for _ in range(60_000))
    rows = [
        (1, None, "en", "a", 0, "x", None), (2, "", "en", "a", 0, "x", None), (3, " \n\t ", None, None, None, None, "y"), (None, "a text without any id at all here now", None, "b", 3, "x", "y"),
        (4, long, "en", "a", len(long), "x", "y"), (5, "the same text of some words that comes twice in here", "en", "b", 1, None, None), (5, "the same text of some words that comes twice in here", "en", "b", 1, None, None),
        (6, "The Same text of some words that comes twice in here", "en", "c", 1, None, None), (7, "word", "en", None, 4, "x", "y"), (8, "1234 !! ***", "en", "c", 4, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
