"""The training-corpus pipeline: each stage calls one operator of cellgrove.llm and keeps its decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.llm import decontaminate, minhash, mixing, quality, secrets
from cellgrove.llm.common import keyed, read, settle


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go; null and empty texts are scored as they are.

    Repeated rows and rows without doc_id are judged alike; columns of any name stay; an empty table stays empty.
    """
    return quality.accepted(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Rows that share a doc_id, or have none, are documents of their own and come after all others; of equal rows one
    stays. Texts without words are in no group and stay.
    """
    own = keyed(docs)
    same = minhash.near_duplicates(own.select(F.col("id").alias("doc_id"), F.col("doc.text").alias("text")))
    return own.join(settle(same.where("not kept").select(F.col("doc_id").alias("gone"))), F.col("id") == F.col("gone"), "left_anti").select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go, each row by its own text; null and empty texts stay."""
    own = keyed(docs)
    hit = decontaminate.contamination(own.select(F.col("id").alias("doc_id"), F.col("doc.text").alias("text")), read(spark, sf_dir, "benchmark"))
    return own.join(settle(hit.where("contaminated").select(F.col("doc_id").alias("gone"))), F.col("id") == F.col("gone"), "left_anti").select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are replaced in the texts (n_chars follows); every row and column stays."""
    return secrets.redact(docs, path="source")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes from each row; null texts have none, a null source is a source of its own."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
