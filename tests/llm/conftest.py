"""Small corpora with every awkward case."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_corpus import corpus  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


ODD = [
    (5000, None, "en", "src0", None),
    (5001, "", "en", None, 0),
    (5002, " \t\n\x0b\x0c\r ", None, "src1", 7),
    (5003, "one", "en", None, 3),
    (5004, "one", "en", "src9", 3),
    (None, "a null id has words too, and this line is long enough", "en", "src0", 50),
    (5005, "long " * 6000 + "tail", "en", "src0", 30004),
    (5006, "Á é ẞ İ ﬁ \x85 \xa0 \U0001f600 <|endoftext|> it's 12", "xx", "src1", 40),
    (5007, "same row repeated, with a line that is long enough", "en", "src0", 50),
    (5007, "same row repeated, with a line that is long enough", "en", "src0", 50),
    (None, "another row without an id, and this line is long enough as well", "en", "src1", 50),
    (None, None, None, "src2", None),
    (5008, "the first text of an id that stands there with two texts", "en", "src0", 50),
    (5008, "and quite another text of that id, which has other words", "en", "src0", 50),
    (-7, "a negative id is an id like any other and comes first", "en", "src0", 50),
]


@pytest.fixture(scope="session")
def rows():
    return corpus() + ODD


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names that the operators use inside.
CLASH = ("node", "key", "_row", "_copies", "_k_id", "_k_hash", "_kept", "_doc", "_new", "_file", "_h", "_text", "_w", "size", "component", "part", "length", "word", "block", "license")


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(c) for c in CLASH})
