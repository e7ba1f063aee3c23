"""The registered queries of this subpackage and the SQL that gives their rows."""

from __future__ import annotations

from kinweave.llm import cuckoo, lm, packing, pieces, pii, rules, simhash, tokenfile, zquality

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_exact_dedup": cuckoo.op2_exact_dedup,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_token_files": tokenfile.op4_token_files,
    "op5_token_counts": pieces.op5_token_counts,
    "op6_packing": packing.op6_packing,
    "op7_quality_classifier": zquality.op7_quality_classifier,
    "op8_quality_rules": rules.op8_quality_rules,
    "op9_pii": pii.op9_pii,
    "op10_lm_scoring": lm.op10_lm_scoring,
}

ORACLE_SQL = {
    "op2_exact_dedup": cuckoo.OP2_SQL,
}
