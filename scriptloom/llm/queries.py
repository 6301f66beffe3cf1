"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, cross_tokens, decontaminate, divergence, jaccard_join, license_scan, lm_scoring, mixing, quality_rules, secret_scan, shards, token_files, warc_revisits

QUERIES = {
    f.__name__: f
    for f in (
        decontaminate.op1_decontaminate, lm_scoring.op2_lm_scoring, warc_revisits.op3_warc_revisits, token_files.op4_token_files,
        jaccard_join.op5_jaccard_join, mixing.op6_mixing, secret_scan.op7_secret_scan, license_scan.op8_license_scan,
        quality_rules.op9_quality_rules, shards.op10_sharding, cross_tokens.op11_cross_tokens, divergence.op12_divergence, byte_bpe.op13_byte_bpe, quality_rules.quality_ablations,
    )
}
ORACLE = {
    "op1_decontaminate": decontaminate.ORACLE, "op3_warc_revisits": warc_revisits.ORACLE, "op8_license_scan": license_scan.ORACLE,
    "op12_divergence": divergence.ORACLE, "op9_quality_rules": quality_rules.ORACLE, "quality_ablations": quality_rules.ABLATIONS_ORACLE,
}
