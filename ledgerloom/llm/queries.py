"""The registered queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, fingerprint, language, lexical, licences, lm, mixing, mtree, neardup, packing, pages, sharding
from .kit import read


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_join(read(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return language.identify(docs, language.learn(docs)).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(read(spark, sf_dir, "pages"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read(spark, sf_dir, "documents"))


def op11_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_mtree_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.best_products(read(spark, sf_dir, "embeddings"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_jaccard_join, op2_lm_scoring, op3_kd_sharding, op4_best_fit_packing, op5_language_id, op6_multi_index_hashing, op7_pareto_mixing, op8_fingerprints, op9_html_extraction, op10_licence_scan, op11_best_position, op12_mtree_products, op13_centroid_clusters)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": neardup.join_sql(),
        "op7_pareto_mixing": mixing.mix_sql(),
        "op8_fingerprints": fingerprint.fingerprint_sql(),
        "op10_licence_scan": licences.scan_sql(),
        "op11_best_position": lexical.rank_sql(),
        "op12_mtree_products": mtree.products_sql(),
        "op13_centroid_clusters": centroids.cluster_sql(),
    }
