from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `RID` string, score double, no_text int"
LONG = "word and more " * 9000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and extra columns whose names clash."""
    row = lambda i, t, **k: (i, t, k.get("lang", "en"), k.get("source", "s"), len(t or ""), "x", 0.5, 1)
    rows = [
        row(1, "The same line is here, and it has more than enough words to be counted as one span of its own.\nOne more."),
        row(2, "The same line is here, and it has more than enough words to be counted as one span of its own.\nAnother."),
        row(3, "The same line is here, and it has more than enough words to be counted as one span of its own.\nAnother."),
        row(3, "The same line is here, and it has more than enough words to be counted as one span of its own.\nAnother."),
        row(4, None, lang=None, source=None),
        row(5, ""),
        row(6, " \n\t "),
        row(None, "No id at all. Released under the MIT License."),
        row(None, None),
        row(7, LONG),
        row(8, LONG),
        row(8, "an other text of the same id"),
        row(9, "12 34 56 !!"),
        row(10, "Größe ÉTÉ \U0001f600 ▁ \x00 x"),
        (None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
