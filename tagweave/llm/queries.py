"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import embedding_dedup, license_scan, line_dedup, lm_scoring, quality_rules, secret_scan, sentencepiece_codec, simhash_dedup, source_mixing, url_filters

QUERIES = {
    "op1_license_scan": license_scan.op1,
    "op2_line_dedup": line_dedup.op2,
    "op3_quality_rules": quality_rules.op3,
    "op4_embedding_dedup": embedding_dedup.op4,
    "op5_sentencepiece": sentencepiece_codec.op5,
    "op6_url_filters": url_filters.op6,
    "op7_lm_scoring": lm_scoring.op7,
    "op8_simhash_dedup": simhash_dedup.op8,
    "op9_secret_scan": secret_scan.op9,
    "op10_source_mixing": source_mixing.op10,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op4_embedding_dedup": embedding_dedup.OP4_SQL,
    "op6_url_filters": url_filters.OP6_SQL,
    "op9_secret_scan": secret_scan.OP9_SQL,
}
