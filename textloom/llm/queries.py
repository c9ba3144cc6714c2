"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, collocations, exact_dedup, filter_audit, license_scan, line_dedup, minhash_dedup, mixing, quality, substring_dedup, suffix_dedup, token_counts, vector_dedup

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_vector_dedup": vector_dedup.op2_vector_dedup,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_minhash_dedup": minhash_dedup.op9_minhash_dedup,
    "op10_quality": quality.op10_quality,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op2_vector_dedup": vector_dedup.SQL,
    "op3_mix_sources": mixing.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_collocations": collocations.SQL,
}
