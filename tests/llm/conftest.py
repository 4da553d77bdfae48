import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = "word another third " * 3000
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, "the house of the cat", "en", "a"), (4, "the house of the cat", "en", "a"),
        (None, "the house of the cat", None, "b"), (6, "The House of the Cat", "en", ""), (7, long, "en", "b"), (8, "1234 !!", "en", "b"), (9, "le chat de la maison 😀 é", "fr", None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("score", "key", "tie", "_key", "_takes", "_found", "pii", "cluster", "row", "bucket"):
        frame = frame.selectExpr("*", f"'x' AS `{name}`")
    return frame.selectExpr("*", "length(text) AS n_chars")


@pytest.fixture(scope="session")
def sf():
    assert os.path.isdir(SF)
    return SF
