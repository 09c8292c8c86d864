"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from loomtrace.llm import (
    align_tokens, bpe, exact_dedup, fingerprint, license_scan, manifest, mixing, near_dedup, quality, secret_scan, sharding, suffix_dedup, toxicity,
)

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_mixing": mixing.op2_mixing,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_sharding": sharding.op8_sharding,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_token_alignment": align_tokens.op11_token_alignment,
    "op12_fingerprint": fingerprint.op12_fingerprint,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op6_suffix_dedup": suffix_dedup.OP6_SQL,
    "op1_quality": quality.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op3_near_dedup": near_dedup.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}
