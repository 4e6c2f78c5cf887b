"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, hmm, licenses, merkle, minhash, mixing, oracles, quality, secrets, substring, suffix, tools, whitening
from .common import read


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.lm_scores(read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring.repeats(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"), path="source")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix.repeats(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.link(*tools.exchanges(read(spark, sf_dir, "conversations")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumn("vec_id", F.col("vec_id").cast("long"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = merkle.manifest(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan_texts(read(spark, sf_dir, "documents")))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: trained models (1, 4, 7), hashes that DuckDB lacks (6, 8), eigenvectors (11), chained matches (13); see tests/llm."""
    return {"op2_substring_dedup": oracles.OP2, "op3_minhash": oracles.OP3, "op5_suffix_dedup": oracles.OP5, "op9_decontaminate": oracles.OP9, "op10_tool_links": oracles.OP10, "op12_merkle": merkle.manifest_sql()}
