"""From raw documents to packed training sequences: five stages, each written as Parquet before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lapel.llm.common import materialise
from lapel.llm.exact_dedup import drop_copies
from lapel.llm.packing import pack
from lapel.llm.quality_rules import keep_good
from lapel.llm.secret_scan import redact
from lapel.llm.simhash import drop_near_copies

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the learned decision list, all columns whatever their names.

    Null, empty and short texts fail the base test. Without labels the base test alone decides. Repeated rows share one
    verdict; an empty table gives no rows.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the least id, all columns whatever their names.

    Null text counts as empty; a null id comes after all others; of rows that repeat id and text one stays.
    """
    return drop_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints, the document with the least id, all columns whatever their names.

    Null text counts as empty; a null id comes after all others; rows that share an id are judged each for itself.
    """
    return drop_near_copies(docs, shingle=4, bits=4)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced (n_chars stays what the source said); null texts stay null."""
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048 tokens; null and empty texts are their end id alone, rows that
    repeat are packed each for itself."""
    return pack(docs, max_tokens=2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules, XXH64 fingerprints and token ids are not SQL; tests/llm compares with a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
