"""Awkward tables shared by the tests of this folder."""

import pytest

SMALL = "/root/testdata/sf0.001"

EDGE = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 10),
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "de", "b", 4),
    (None, "no id here but some words to read", "en", None, 5),
    (5, "word " * 60_000, "en", "a", 300_000),
    (6, "Ein Satz über Äpfel und Öl; mail an bob@example.com, 10.0.0.1!", "de", "c", 50),
    (7, "日本語のテキスト 123 \U0001f600 ééé", None, "c", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties."""
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge):
    """Columns named like those the operators use inside."""
    names = ("label", "fp", "row", "piece", "host", "rank", "held_out", "score", "words", "ref", "part", "n", "digest",
             "low", "row", "features", "__digest", "__text", "__n_entities", "longer", "new")
    for name in names:
        edge = edge.withColumn(name, edge["source"])
    return edge


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (6, 1, 0), (7, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
