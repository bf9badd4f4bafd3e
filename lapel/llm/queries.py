"""The queries of this package by key, bound to the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapel.llm import (
    decontamination,
    exact_dedup,
    fill_in_middle,
    packing,
    quality_rules,
    secret_scan,
    sentencepiece_dropout,
    simhash,
    source_audit,
    substring_dedup,
    suffix_dedup,
    token_ledger,
    warc,
)
from lapel.llm.common import materialise, scratch_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, folder, "documents"), k=20, keep_text=False).drop("kept")


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, folder, "documents"), shingle=4, bits=4, seed=42)


def op3_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents inserted; those labelled toxic deleted; those whose runs of blanks shrink counted anew; and the
    first batch sent once more, which changes nothing."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    squeezed = F.regexp_replace("text", r"[\x20\x09-\x0D]{2,}", " ")
    counts = materialise(token_ledger.token_counts(docs), "counts")
    again = materialise(token_ledger.token_counts(docs.filter(squeezed != F.col("text")).withColumn("text", squeezed)), "recounts")
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    ledger = token_ledger.TokenLedger(spark, scratch_path(spark, "ledger"))
    load = token_ledger.inserted(token_ledger.versions(counts))
    ledger.commit("load", load)
    ledger.commit("withdraw", token_ledger.deleted(token_ledger.versions(counts.join(toxic, "doc_id", "left_semi"))))
    fresh = again.join(toxic, "doc_id", "left_anti")
    stale = counts.join(fresh.select("doc_id"), "doc_id", "left_semi")
    ledger.commit("recount", token_ledger.revised(token_ledger.versions(stale), token_ledger.versions(fresh)))
    ledger.commit("load", load)
    return ledger.totals()


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_sentencepiece_dropout(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_dropout.round_trip(_table(spark, folder, "documents"), seed=20, dropout=0.1)


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(_table(spark, folder, "documents"))


def op7_warc_writer(spark: SparkSession, folder: str) -> DataFrame:
    archives = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, folder, "pages"), archives, least_revisit_bytes=1000)
    return warc.read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, folder, "documents"), width=50, keep_text=False).drop("kept")


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), max_tokens=2048)


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, folder, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), window=10)


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.divergence(_table(spark, folder, "documents"), least_docs=10, top=10)


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.digest(_table(spark, folder, "documents"), seed=1, plain=10, spm=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_simhash_near_dedup,
        op3_token_rollup,
        op4_quality_rules,
        op5_sentencepiece_dropout,
        op6_secret_scan,
        op7_warc_writer,
        op8_suffix_array_dedup,
        op9_best_fit_packing,
        op10_exact_dedup,
        op11_benchmark_decontamination,
        op12_source_divergence,
        op13_fill_in_middle,
    )
}

#: The others hold learned rules, XXH64, code-point positions or token ids; tests/llm compares them with brute force.
ORACLE: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.oracle(),
    "op7_warc_writer": warc.oracle(),
    "op8_suffix_array_dedup": suffix_dedup.oracle(),
    "op10_exact_dedup": exact_dedup.oracle(),
    "op11_benchmark_decontamination": decontamination.oracle(),
    "op12_source_divergence": source_audit.oracle(),
    "op13_fill_in_middle": fill_in_middle.oracle(),
}
