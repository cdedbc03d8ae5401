"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, language_id, line_dedup, packing, quality_classifier, quality_rules, secret_scan, simhash_dedup, substring_dedup, topk_search
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": _on("documents", substring_dedup.removal_digest),
        "op2_quality_classifier": lambda spark, sf_dir: quality_classifier.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op3_language_id": _on("documents", language_id.identify),
        "op4_secret_scan": _on("documents", secret_scan.scan_report),
        "op5_topk_search": _on("embeddings", topk_search.embedding_top_k),
        "op6_bpe": _on("documents", lambda docs: bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))),
        "op7_quality_rules": _on("documents", quality_rules.quality_report),
        "op8_simhash_dedup": _on("documents", simhash_dedup.fingerprint_groups),
        "op9_packing": _on("documents", lambda docs: packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))),
        "op10_line_dedup": _on("documents", line_dedup.line_digest),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring_dedup.ORACLE, "op5_topk_search": topk_search.ORACLE, "op10_line_dedup": line_dedup.ORACLE}
