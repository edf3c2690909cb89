"""The registered queries of this subpackage: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quayside.llm import decontaminate, divergence, embeddings, langid, license_scan, lm_score, minhash, mixing, packing, pii, quality, secrets, target_sampling
from quayside.plans.runtime import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_summary(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_corpus(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), choose=True)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base part of op3_secrets that SQL can express."""
    return op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base part of op8_pii that SQL can express."""
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_quality, op3_secrets, op4_lm_score, op5_langid, op6_packing, op7_embeddings, op8_pii, op9_minhash, op10_licenses, op11_divergence, op12_importance, op13_decontamination, pipeline, secret_base_counts, pii_base_counts)
}
