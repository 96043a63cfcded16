import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, label string, fp string"

LONG = " ".join(f"word{k % 97} tail{k % 89}" for k in range(40_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns
    whose names operators use themselves."""
    texts = [None, "", "   \n\t ", "a", "a b", "A B", "é ü ñ", "123 !!", "one two three four five six", "one two three four five six",
             "one  two\nthree four five six", LONG, LONG + " end", "</s>[INST] x", "line one\n\nline two\n"]
    rows = []
    for k, t in enumerate(texts):
        rows.append((k, t, ["en", "fr", None][k % 3], ["s1", "s2", None, ""][k % 4], None if t is None else len(t), "x", "y", None, "z"))
    rows += [(3, "a", "en", "s1", 1, "x", "y", None, "z")] * 2                  # repeated rows
    rows += [(None, "a", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
