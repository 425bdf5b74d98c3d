"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOREM = "the quick brown fox jumps over the lazy dog while seven small birds watch from a quiet garden wall near the river"


def awkward(spark):
    """Null in every column, empty and blank texts, a very long text, ties and repeated rows."""
    long_text = " ".join(f"{LOREM} {i}" for i in range(400))
    rows = [
        (1, LOREM, "en", "a", 10), (2, LOREM, "en", "a", 10), (3, LOREM.upper(), "en", "b", None), (3, LOREM.upper(), "en", "b", None),
        (4, None, "en", "a", 0), (5, "", None, None, 0), (6, " \t\n\r\x0b\f", "de", "b", 6), (7, "one", "de", "b", 3),
        (8, "two words", None, "c", 9), (9, long_text, "en", None, len(long_text)), (10, "héllo wörld \U0001f600 世界 x y", "fr", "c", 20),
        (None, "row without an id", "en", "a", 17), (11, "a" * 5000, "en", "a", 5000), (12, "x\u0000y � 12 345", "es", "c", 9),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
