from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


LONG = " ".join(f"w{i}" for i in range(3000))
COPY = "one line of plain words that repeats\nand another line with some more words to fill the text up to its length"
ODD_ROWS = [
    (1, COPY, "en", "a", 10, "x", 0),
    (2, COPY, "en", "b", 10, "y", 1),
    (2, COPY, "en", "b", 10, "y", 1),
    (2, "another text under the same id", "fr", "c", 10, "y", 1),
    (3, None, None, None, None, None, None),
    (4, "", "en", "a", 0, "z", 2),
    (5, " \t\n\x0b ", "en", "a", 5, "z", 2),
    (6, "12 34 !! ##", "en", "a", 11, "z", 2),
    (7, LONG, "de", "a", len(LONG), "z", 2),
    (8, LONG + " tail", "de", "b", len(LONG), "z", 2),
    (None, "a text without an id, é日本𝄞", "en", "a", 20, "z", 2),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns named like the operators' own."""
    return spark.createDataFrame(ODD_ROWS, "doc_id long, text string, lang string, source string, n_chars long, fp string, row_key int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
