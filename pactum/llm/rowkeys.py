"""Keys of document rows.

``doc_id`` names a document. Rows may repeat it, and it may be null, so results
that go back to rows are matched null-safely on ``doc_id`` and a hash of the
text: repeated equal rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.plans.scratch import small

TEXT_HASH = "_text_hash"

#: Java form of the white space that separates words.
SPACE = "[\\x20\\x09-\\x0D]+"


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def only_rows(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) is among ``keys`` (a written table of doc_id, _text_hash)."""
    k = small(keys.select(F.col("doc_id").alias("_k_id"), F.col(TEXT_HASH).alias("_k_hash")))
    rows = docs.select(F.struct("*").alias("_row"))
    return rows.join(k, F.col("_row.doc_id").eqNullSafe(F.col("_k_id")) & (text_hash(F.col("_row.text")) == F.col("_k_hash")), how).select("_row.*")
