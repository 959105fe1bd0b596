"""The corpus pipeline: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's documents. All but the last return the
columns of ``documents``, in their types; further columns are carried.

Null texts and texts without a word fail the quality rules. Rows of null doc_id
are documents of their own, rows that repeat a doc_id one document. Texts of any
length are read whole. Ties are settled by the smaller doc_id, in the first stages
by line number as well. An empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactum.llm import linededup, mixing, neardup, packing, quality
from pactum.plans import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Those without ten words, with many repeated word windows, or depleted by lines that
    many documents of their source share, go; see ``quality`` for null and repeated ids.
    """
    return quality.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats or nearly repeats; emptied documents go.

    Rows equal in doc_id and text keep the same lines; null ids come last.
    """
    return linededup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id.

    Of rows equal in doc_id and text one stays. Rows of null doc_id stay unless a
    document with an id has an equal set of shingles.
    """
    return neardup.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times; a null source is one of its own."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences; copies are packed each."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("source mix", source_mix), ("packing", pack)]

#: MinHash and tokenization have no SQL form; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way is deleted once its documents are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with scratch.scope() as kept:
            out = scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(out)
        if before is not None:
            scratch.discard(before)
        docs = before = out
    return docs
