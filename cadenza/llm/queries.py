"""The registered corpus queries and their SQL."""

from __future__ import annotations

from cadenza.llm import audit, binary, bpe, crosstoken, fingerprint, jaccard, licenses, lines, mix, pii, quality, topk, urls

QUERIES = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_quality": quality.op3_quality,
    "op4_url_filter": urls.op4_url_filter,
    "op5_scaled_sketch": fingerprint.op5_scaled_sketch,
    "op6_token_files": binary.op6_token_files,
    "op7_pii": pii.op7_pii,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_mix_sources": mix.op9_mix_sources,
    "op10_maxscore_topk": topk.op10_maxscore_topk,
    "op11_license_scan": licenses.op11_license_scan,
    "op12_token_alignment": crosstoken.op12_token_alignment,
    "op13_filter_audit": audit.op13_filter_audit,
}
ORACLES = {
    "op4_url_filter": urls.OP4_SQL,
    "op8_line_dedup": lines.OP8_SQL,
    "op9_mix_sources": mix.OP9_SQL,
    "op10_maxscore_topk": topk.OP10_SQL,
    "op11_license_scan": licenses.OP11_SQL,
    "op13_filter_audit": audit.OP13_SQL,
}
