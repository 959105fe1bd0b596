"""The registered queries of the corpus jobs: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm import centroids, idfiles, lexical, licenses, linededup, mixing, neardup, packing, quality, secrets, topk, toxicity, treeweight
from pactum.llm.rowkeys import TEXT_HASH

ORACLES: dict[str, str] = {"op1_line_dedup": linededup.SQL, "op4_license_scan": licenses.SQL, "op5_quality_rules": quality.SQL, "op8_source_mixing": mixing.SQL, "op9_bit_sliced_topk": topk.SQL, "op11_shared_term_search": lexical.SQL, "op13_simplex_clusters": centroids.SQL}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.duplicate_lines(_documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), shingle_words=2, percent=80)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its id below its source, below its language there, or a folder further down; every fourth is named as a license."""
    docs, k = _documents(spark, sf_dir), F.col("doc_id")
    name = F.concat(F.when(k % 4 == 1, "LICENSE-").otherwise(""), k, F.lit(".txt"))
    path = F.when(k % 3 == 0, F.concat_ws("/", "source", name)).when(k % 3 == 1, F.concat_ws("/", "source", "lang", name)).otherwise(F.concat_ws("/", "source", "lang", F.concat(F.lit("k"), k % 5), name))
    files = docs.select("doc_id", path.alias("path"), "text")
    return licenses.scan_licenses(files).select("doc_id", "license", F.round("cosine", 6).alias("cosine"), "origin", "n_headers", F.array_join("licenses", ",").alias("licenses"), "license_dir")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_documents(spark, sf_dir)).drop(TEXT_HASH)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_documents(spark, sf_dir))


def op7_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.read_ids(idfiles.written_ids(_documents(spark, sf_dir)))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop(TEXT_HASH)


def op9_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op10_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treeweight.score_documents(_documents(spark, sf_dir), depth=5)


def op11_shared_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_best_fit_packing, op3_minhash_neardup, op4_license_scan, op5_quality_rules, op6_secret_scan, op7_token_id_files, op8_source_mixing, op9_bit_sliced_topk, op10_context_tree_scores, op11_shared_term_search, op12_weak_toxicity, op13_simplex_clusters)}
