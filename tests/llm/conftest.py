import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(400)]
    return " ".join(rng.choice(words, n))


def make(spark, rows, schema=DOCS):
    """Rows of (doc_id, text) or whole ones."""
    return spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) if len(r) == 2 else r for r in rows], schema)


@pytest.fixture
def rng():
    return np.random.default_rng(5)


@pytest.fixture
def odd(spark, rng):
    """Nulls, empty and very long texts, ties, repeated rows, and clashing column names."""
    long = prose(rng, 30_000)
    rows = [(None, None), (None, "alpha beta gamma"), (1, None), (2, ""), (3, "   \n\t\n "), (4, "a"), (5, long), (6, long), (7, "same text here\nsame text here"), (7, "same text here\nsame text here"), (8, "!!! ... ???"), (9, "x\x00y \U0001f600 é")]
    more = "doc_id long, text string, lang string, source string, n_chars long, row long, node string, bad_id long, key long, anchor string, rank int, n_gone int"
    return make(spark, [(i, t, "en", None, None, 1, "n", 2, 3, "a", 4, 5) for i, t in rows], more)


@pytest.fixture
def none(spark):
    return make(spark, [])
