"""The pipeline against its stages done by hand."""

from __future__ import annotations

import re

import corpus_pipeline
from lapel.llm import quality_rules, secret_scan
from tests.llm.data import DATA, awkward, documents, table
from tests.llm.test_dedup import near_by_hand
from tests.llm.test_text import base_by_hand, check_packing, reference_tokens  # noqa: F401


def by_hand(spark, docs, rules):
    """Ids and texts that reach the packing."""
    stats = quality_rules.with_statistics(docs.select("doc_id", "text")).withColumn("keep", quality_rules.verdict(rules)).collect()
    rows = sorted((r["doc_id"], r["text"]) for r in stats if r["keep"] and not base_by_hand(r["text"])[-1])
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    near = near_by_hand(list(first.values()))
    stay = {i for i, _, c in near if i == c}
    return [(i, secret_scan.redacted(t, secret_scan.secret_spans(t))) for i, t in first.values() if i in stay]


def test_pipeline(spark, reference_tokens):  # noqa: F811
    docs = table(spark, "documents")
    expected = by_hand(spark, docs, quality_rules.learn(docs, table(spark, "labels")))
    assert 0 < len(expected) < docs.count()
    found = corpus_pipeline.run(spark, DATA).collect()
    bins, least = check_packing(found, expected, reference_tokens)
    assert {r["doc_id"] for r in found} == {i for i, _ in expected}
    assert bins <= least * 1.02 + 1


def test_stages_take_awkward_rows_and_hand_on_all_columns(spark):
    for rows in (awkward(), []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns
            out.collect()
        assert {"doc_id", "sequence_id"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, DATA).columns)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
