import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from brute import SF  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, more columns."""
    long = " ".join(f"word{i % 977} other{i % 1009}." for i in range(40_000))
    base = " ".join(f"alpha{i} beta{i}" for i in range(30)) + "."
    rows = [
        (1, base, "en", "a", 5),
        (2, base, "en", "a", 5),
        (2, base, "en", "a", 5),
        (3, base.upper(), None, None, None),
        (4, None, "en", "a", None),
        (5, "", "en", "b", 0),
        (6, " \n\t ", None, "b", 4),
        (None, base, "de", "c", 9),
        (None, None, None, None, None),
        (7, long, "en", "a", 1),
        (8, long + " end", "en", "b", 1),
        (9, "one", "en", "b", 3),
        (10, "ONE", "fr", "b", 3),
        (11, "  Ünïcode ß 日本語 \U0001f600 ### ", "de", "c", 9),
    ]
    frame = spark.createDataFrame([(*r, i, "x", True) for i, r in enumerate(rows)], DOC + ", size long, node string, kept boolean")
    return frame


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
