from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keys string, words string, ids string, h bigint, f string, g string, size string, _locator string, _metadata string, _row int, n_words string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text, lang, source), with more columns whose names operators use inside."""

    def build(rows: list[tuple], partitions: int = 3):
        full = [(i, t, lang, source, len(t or ""), "k", "w", "i", 7, "f", "g", "s", "l", "m", 8, "n") for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def awkward(make):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"word{k % 3000} and" for k in range(40_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", None), (5, long, "en", "a"), (5, long, "en", "a"),
        (6, "same words here twice over and over again friend", "de", "b"), (7, "same words here twice over and over again friend", "de", "b"),
        (None, "a row without an identifier but with some words in it today", "fr", "c"), (8, "x" * 5000, "en", "b"), (9, "tail 𠮷 é ▁ \u0000 end", "es", "c"),
    ]
    return make(rows)
