from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", size long, row string, fp int, bucket string, `key` string, runs int, component_id long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in every column, empty, repeated and long texts, and clashing extra columns."""
    long_text = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 1),
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 1),
        (None, "alpha BETA gamma delta epsilon zeta", None, None, None),
        (2, None, "en", "b", None),
        (3, "", "en", "b", 0),
        (4, " \t\n ", "en", None, 4),
        (5, long_text, "en", "a", len(long_text)),
        (6, "é" * 700 + " naïve", "fr", "c", 3),
        (7, "one", "en", "c", 3),
    ]
    extra = (1, "r", 2, "b", "k", 3, 4)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA + CLASH)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
