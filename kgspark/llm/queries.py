"""Registry of the training-data queries and of the SQL that some compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, classifier, licences, linededup, media, merkle, neighbours, packing, passages, repair, simhash, suffix, tokencount

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_gam": classifier.op1_quality_gam,
    "op2_token_counts": tokencount.op2_count_tokens,
    "op3_fuzzy_lines": linededup.op3_fuzzy_lines,
    "op4_simhash_anchors": simhash.op4_simhash_anchors,
    "op5_induced_suffixes": suffix.op5_induced_suffixes,
    "op6_compact_windows": passages.op6_compact_windows,
    "op7_bpe_merge_replay": bpe.op7_bpe_merge_replay,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_transport_stream": media.op9_transport_stream,
    "op10_metric_range_join": neighbours.op10_metric_range_join,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_license_scan": licences.op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {"op11_conversation_repair": repair.oracle_sql(), "op12_merkle_manifest": merkle.oracle_sql()}
