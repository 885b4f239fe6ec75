"""Rows with every oddity the operators must take."""

from __future__ import annotations

import pytest

ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (None, "Der schnelle Fuchs springt.", "de", "b", 5),
    (None, None, "de", None, None),
    (5, " \t\n ", None, "b", 4),
    (6, "x", "zz", "b", 1),
    (7, "word " * 20_000, "en", "c", 100_000),
    (8, "é😀 ñandú öde", "es", "c", 12),
    (9, "one two", "en", None, 7),
    (10, "line one is long enough to count\n\nline one is long enough to count\nshort", "en", "a", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
