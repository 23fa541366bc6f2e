"""Small tables of documents, among them the awkward ones."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows):
        full = [(i, t, None, "s", None) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls in both columns, empty and very long texts, repeated rows, ties."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "One two three four five six."), (6, "One two three four five six."),
        (7, "one TWO three four five six."), (None, "no id here at all, none"), (None, None), (8, "x"), (9, "ÄÖ ü ñ\n\nñ"), (10, "12 34"), (11, "a\x00b \x1c c"),
    ]
