"""The registered queries of the subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from . import chat, ctw, exact_dedup, jaccard_join, language_id, license_scan, packing, pii, ring_shards, wu_manber

QUERIES = {
    "op1_packing": packing.query,
    "op2_license_scan": license_scan.query,
    "op3_ctw": ctw.query,
    "op4_wu_manber": wu_manber.query,
    "op5_pii": pii.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_chat": chat.query,
    "op8_ring_shards": ring_shards.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_language_id": language_id.query,
}

ORACLES = {
    "op4_wu_manber": wu_manber.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
}
