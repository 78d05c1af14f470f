"""Registered queries of the numbered operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import (
    alignment, decontamination, fingerprints, jaccard, lm, mixing, neighbours, pii, prefix_trie, quality, secret_scan,
    suffixes, toxicity,
)
from lectern.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": lambda spark, sf: jaccard.op1(table(spark, sf, "documents")),
    "op2_pii": lambda spark, sf: pii.op2(table(spark, sf, "documents")),
    "op3_quality": lambda spark, sf: quality.op3(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op4_fingerprints": lambda spark, sf: fingerprints.op4(table(spark, sf, "documents")),
    "op5_lm_score": lambda spark, sf: lm.op5(table(spark, sf, "documents")),
    "op6_decontaminate": lambda spark, sf: decontamination.op6(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")
    ),
    "op7_mix_sources": lambda spark, sf: mixing.op7(table(spark, sf, "documents")),
    "op8_remove_repeats": lambda spark, sf: suffixes.op8(table(spark, sf, "documents")),
    "op9_toxicity": lambda spark, sf: toxicity.op9(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op10_secrets": lambda spark, sf: secret_scan.op10(table(spark, sf, "documents")),
    "op11_neighbours": lambda spark, sf: neighbours.op11(table(spark, sf, "embeddings")),
    "op12_align_tokens": lambda spark, sf: alignment.op12(table(spark, sf, "documents")),
    "op13_prefix_trie": lambda spark, sf: prefix_trie.op13(table(spark, sf, "conversations")),
}

#: The other results rest on trained weights or edit distances and are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": jaccard.SQL, "op4_fingerprints": fingerprints.SQL, "op7_mix_sources": mixing.SQL,
    "op8_remove_repeats": suffixes.SQL, "op10_secrets": secret_scan.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
