"""Edits on pieces against edits on strings, and what they cost."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pactum.operators import text as texts
from pactum.operators.pieces import Pieces


def spliced(text, start, end, new):
    """On the string itself; places beyond a line or the text fall on its end."""

    def offset(line, col):
        lines = text.split("\n")
        before = sum(len(x) + 1 for x in lines[:line])
        return min(before + (min(col, len(lines[line])) if line < len(lines) else 0), len(text))

    a = offset(*start)
    b = max(a, offset(*end))
    return text[:a] + new + text[b:]


@pytest.mark.parametrize("size", [1, 3, 8, 4096])
def test_pieces_equal_strings(size):
    rng = random.Random(size)
    for _ in range(60):
        pieces, plain = Pieces(size=size), ""
        for _ in range(25):
            new = "".join(rng.choice("ab\n\u00e9") for _ in range(rng.randrange(12)))
            if rng.random() < 0.1:
                pieces.replace(new)
                plain = new
            else:
                a, b = ((rng.randrange(5), rng.randrange(7)) for _ in range(2))
                pieces.splice(a, b, new)
                plain = spliced(plain, a, b, new)
            assert pieces.text() == plain
            assert [len(pieces.piece(i)) for i in range(len(pieces.names))] == pieces.chars.tolist()
        assert not size > 8 or len(pieces.names) <= 1 + 2 * len(plain) // size + 2


def test_cases_of_one_edit():
    for text, a, b, new, wanted in [("ab\ncd", (0, 1), (1, 1), "X", "aXd"), ("ab", (0, 9), (9, 9), "!", "ab!"), ("ab\n", (1, 0), (1, 0), "c", "ab\nc"), ("ab\ncd", (1, 1), (0, 0), "_", "ab\nc_d"), ("", (3, 3), (4, 4), "x", "x"), ("a\nb", (0, 5), (0, 5), "-", "a-\nb")]:
        pieces = Pieces(size=2)
        pieces.replace(text)
        pieces.splice(a, b, new)
        assert pieces.text() == wanted


def took(n, chars):
    rng, pieces = random.Random(1), Pieces()
    pieces.replace("some line\n" * (chars // 10))
    began = time.perf_counter()
    for _ in range(n):
        line = rng.randrange(chars // 10)
        pieces.splice((line, 2), (line, 4), "xyz")
    assert len(pieces.text()) == chars // 10 * 10 + n
    return time.perf_counter() - began


def test_ten_thousand_edits_cost_what_they_change():
    few, many, longer = took(2_500, 1_000_000), took(10_000, 1_000_000), took(10_000, 4_000_000)
    assert many < 10 * few + 0.5 and longer < 3 * many + 0.5 and many < 5


LOG = "doc string, seq long, start_line int, start_col int, end_line int, end_col int, text string, _base int"


def test_logs_of_many_documents(spark):
    rng, rows, plain = random.Random(2), [], {}
    for i in range(400):
        doc, new = rng.choice(["a", "b", None, "c"]), rng.choice(["x", "yy\nz", "", "q\n"])
        if rng.random() < 0.05:
            rows.append((doc, i, None, None, None, None, new, 0))
            plain[doc] = new
        else:
            a, b = ((rng.randrange(4), rng.randrange(6)) for _ in range(2))
            rows.append((doc, i, *a, *b, new, 0))
            plain[doc] = spliced(plain.get(doc, "base\ntext" if doc == "c" else ""), a, b, new)
    base = spark.createDataFrame([("c", "base\ntext"), ("d", "unedited")], "doc string, text string")
    got = texts.apply_edit_log(spark.createDataFrame(rows, LOG).repartition(5), "doc", base)
    assert got.columns == ["doc", "text"] and {r["doc"]: r["text"] for r in got.collect()} == plain


def test_only_edits_after_the_last_replacement_are_folded(spark):
    rows = [("a", i, 0, 0, 0, 0, "x") for i in range(50)] + [("a", 50, None, None, None, None, "new"), ("a", 51, 0, 3, 0, 3, "er")]
    df = texts.apply_edit_log(spark.createDataFrame(rows, LOG.rsplit(",", 1)[0]), "doc")
    assert df.first()["text"] == "newer"
    assert texts.apply_edit_log(spark.createDataFrame([], LOG.rsplit(",", 1)[0]), "doc").count() == 0
    assert df.select(F.length("text")).first()[0] == 5
