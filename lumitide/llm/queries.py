"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, htmltext, licenses, mil, minhash, pii, pivotal, pstable, suffixes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(_table(spark, sf_dir, "pages"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.salvage_pages(_table(spark, sf_dir, "pages"))


def op3_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


def op6_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mil.score(docs, mil.fit(docs, _table(spark, sf_dir, "labels")))


def op8_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op9_pivotal_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal.mixture(_table(spark, sf_dir, "documents"))


def op10_pstable_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [
        op1_html_tag_path_ratios, op2_warc_salvage, op3_minhash_bayes, op4_bm25_decontamination, op5_license_scan,
        op6_sparse_suffix_dedup, op7_mil_quality, op8_pii_anchor_expansion, op9_pivotal_mixture, op10_pstable_embeddings,
    ]
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return ORACLES
