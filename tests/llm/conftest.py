"""Rows that every operator must bear."""

from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 977}, and {i}" for i in range(30_000))
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties and repeated rows, and columns with clashing names."""
    rows = [
        (1, "one two three four five six seven", "en", "s0", 1),
        (1, "one two three four five six seven", "en", "s0", 1),
        (2, None, "en", "s0", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "fr", "s1", 3),
        (None, "no id here but words and words", "en", None, 5),
        (5, LONG, "en", "s1", len(LONG)),
        (6, "ONE two three four five six seven", None, "s1", 7),
        (7, "\U0001f600 é\u00a0ß " * 30, "de", "s0", 9),
    ]
    out = spark.createDataFrame(rows, DOCUMENTS)
    for name in ("id", "key", "size", "lines", "count", "place", "n", "start", "copies", "found", "spans", "a", "x", "_key", "rank", "h"):
        out = out.selectExpr("*", f"'clash' as {name}")
    return out
