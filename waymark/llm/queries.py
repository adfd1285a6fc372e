"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from waymark.llm import chunks, covertree, dartminhash, mixing, packing, pii, quality, secrets, suffixes, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_mix_sources,
        quality.op2_quality,
        suffixes.op3_repeated_strings,
        dartminhash.op4_near_duplicates,
        secrets.op5_secrets,
        toxicity.op6_toxicity,
        covertree.op7_top_k,
        pii.op8_pii,
        chunks.op9_fingerprints,
        packing.op10_best_fit_packing,
    )
}
ORACLES = {"op1_mix_sources": mixing.ORACLE, "op7_top_k": covertree.ORACLE}
