"""The corpus queries and their SQL, for the entry module."""

from __future__ import annotations

from depthforge.llm import alignment, decontam, html, jaccard, licenses, lines, manifest, packing, pii, quality, substrings, suffix, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_pii": pii.op2,
    "op3_substring_dedup": substrings.op3,
    "op4_quality_rules": quality.op4,
    "op5_decontamination": decontam.op5,
    "op6_license_scan": licenses.op6,
    "op7_suffix_dedup": suffix.op7,
    "op8_toxicity": toxicity.op8,
    "op9_line_dedup": lines.op9,
    "op10_jaccard_join": jaccard.op10,
    "op11_token_alignment": alignment.op11,
    "op12_html_extraction": html.op12,
    "op13_merkle_manifest": manifest.op13,
}

ORACLES = {
    "op3_substring_dedup": substrings.OP3_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op5_decontamination": decontam.OP5_SQL,
    "op6_license_scan": licenses.OP6_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op10_jaccard_join": jaccard.OP10_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}
