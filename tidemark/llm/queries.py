"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, chat_format, cotraining, fingerprints, jaccard_join, line_dedup, merkle, mixing, periodic_runs, quality_rules, secret_scan, topk_search, warc

QUERIES = {
    "op1_cotraining": cotraining.query,
    "op2_topk_search": topk_search.query,
    "op3_line_dedup": line_dedup.query,
    "op4_chat_format": chat_format.query,
    "op5_warc": warc.query,
    "op6_quality_rules": quality_rules.query,
    "op7_jaccard_join": jaccard_join.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_source_mixing": mixing.query,
    "op10_secret_scan": secret_scan.query,
    "op11_fingerprints": fingerprints.query,
    "op12_merkle_manifest": merkle.query,
    "op13_periodic_runs": periodic_runs.query,
}
ORACLES = {
    "op2_topk_search": topk_search.oracle,
    "op3_line_dedup": line_dedup.oracle,
    "op4_chat_format": chat_format.oracle,
    "op5_warc": warc.oracle,
    "op6_quality_rules": quality_rules.oracle,
    "op9_source_mixing": mixing.oracle,
    "op11_fingerprints": fingerprints.oracle,
    "op12_merkle_manifest": merkle.oracle,
}
