"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from . import content_store, decontamination, fingerprints, jaccard_join, language_id, line_dedup, packing, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_language_id": language_id.op7_language_id,
    "op8_content_store": content_store.op8_content_store,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_sharding": sharding.op10_sharding,
}
ORACLE_SQL = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op9_fingerprints": fingerprints.OP9_SQL,
    "op10_sharding": sharding.OP10_SQL,
}
