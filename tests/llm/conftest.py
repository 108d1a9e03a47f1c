import sys

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor long, start int, shard int, n_words long, _size long"


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names operators use."""
    lorem = " ".join(f"w{i % 97}x{i}" for i in range(130))
    long = " ".join(f"v{i * 7919 % 5003}" for i in range(60_000))
    rows = [
        (1, lorem, "en", "a", 1, 1, 1, 1, 1, 1),
        (2, lorem, "en", "a", 1, 1, 1, 1, 1, 1),
        (2, lorem, "en", "a", 1, 1, 1, 1, 1, 1),
        (3, lorem + " tail", None, "a", None, None, None, None, None, None),
        (4, None, None, None, None, None, None, None, None, None),
        (5, "", "en", "b", 0, 0, 0, 0, 0, 0),
        (6, " \n\t ", "en", "b", 0, 0, 0, 0, 0, 0),
        (7, "one two", "en", "b", 0, 0, 0, 0, 0, 0),
        (8, "one two", "en", "c", 0, 0, 0, 0, 0, 0),
        (9, long, "en", "c", 0, 0, 0, 0, 0, 0),
        (10, long + " " + lorem, "en", "c", 0, 0, 0, 0, 0, 0),
        (None, lorem, "en", "a", 1, 1, 1, 1, 1, 1),
        (None, None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark, folder):
    """(doc_id, text) of the smallest documents table, by id."""
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())


sys.setrecursionlimit(5000)
