"""Queries of this subpackage: ``opN_<name>`` applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, licenses, lm_scores, merkle, mixing, pii, prefix_trie, quality, simhash, token_counts, token_files, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_token_files": token_files.op6_token_files,
    "op7_warc_fixity": warc.op7_warc_fixity,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_pii": pii.op10_pii,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_lm_scores": lm_scores.op12_lm_scores,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op3_source_mixing": mixing.OP3_SQL,
    "op7_warc_fixity": warc.OP7_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
