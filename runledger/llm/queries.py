"""The queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, filter_audit, line_dedup, lm_scoring, minhash_dedup, packing, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_output, vector_codes, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_minhash_dedup": minhash_dedup.op2_minhash_dedup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_token_output": token_output.op7_token_output,
    "op8_lm_scoring": lm_scoring.op8_lm_scoring,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_warc": warc.op10_warc,
    "op11_simhash_dedup": simhash_dedup.op11_simhash_dedup,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
SQL = {
    "op6_quality_rules": quality_rules.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op10_warc": warc.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
