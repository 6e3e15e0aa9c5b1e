import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, lang, source); with columns that clash and one extra."""

    def make(rows, extra=()):
        rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(rows, DOCS)
        for name in extra:
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture
def odd_rows():
    """Nulls, blanks, a very long text, equal rows, equal texts."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
    return [
        (1, "alpha beta gamma delta", "en", "a"),
        (1, "alpha beta gamma delta", "en", "a"),
        (2, None, None, None),
        (None, "alpha beta gamma delta", "de", "b"),
        (3, "", "en", "a"),
        (4, " \t\n ", "de", None),
        (5, long, "en", "c"),
        (6, "alpha beta gamma delta", "de", "b"),
        (7, "Ünïcödé ワード 🙂 text", "en", "c"),
    ]
