import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels embeddings conversations".split()
DOC = "doc_id bigint, text string, lang string, source string, n_words string, kept string, score string, size string, digest string, fp string"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("test tables absent")
    return DATA


@pytest.fixture(scope="session")
def db(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like results."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    plain = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, plain, "en", "a"), (1, plain, "en", "a"), (2, plain, None, "a"), (3, None, "en", None), (3, "", "en", "b"), (None, None, None, None),
        (None, "Ärger \x0b über\tAlles " * 5, "de", "b"), (4, long, "en", "a"), (5, " \n\t ", "fr", "b"), (6, "x", "fr", "c"), (7, plain.upper(), "en", "c"),
    ]
    return spark.createDataFrame([(*r, "n", "k", "s", "z", "d", "f") for r in rows], DOC)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
