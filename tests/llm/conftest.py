import random

import pytest

LONG = "lorem " * 60_000


def sentence(rng, n, words=("the", "of", "and", "river", "stone", "light", "harbour", "night", "walked", "quiet", "door", "keeper", "old", "ship", "bell")):
    return " ".join(rng.choice(words) + rng.choice(("", "", "s", "ly", "ed")) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names clash with results."""
    rows = [
        (1, "A plain text of some words.", "en", "a", 27, 0.5, "x"),
        (1, "A plain text of some words.", "en", "a", 27, 0.5, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 0.1, "x"),
        (4, " \t\n ", "en", None, 4, 0.1, "x"),
        (5, LONG, "en", "b", len(LONG), 0.9, "y"),
        (None, "A text without an id, of some words.", "de", "b", 10, 0.9, "y"),
        (None, None, None, None, None, None, None),
        (7, "日本語の文。Ünïcödé 🙂 ▁mark\x00end", "fr", "c", 9, 0.2, "z"),
        (-8, "A plain text of some words.", "en", "a", 27, 0.5, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture()
def rng():
    return random.Random(7)
