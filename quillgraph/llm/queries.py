"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from quillgraph.llm import bpe, exact_dedup, lattice_lm, license_scan, mixing, quality, simhash, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_lattice_likelihood": lattice_lm.op3_lattice_likelihood,
    "op4_bpe_encode_decode": bpe.op4_bpe_encode_decode,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_suffix_array_dedup": suffix_dedup.op6_suffix_array_dedup,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_token_counts": token_counts.op10_token_counts,
}

ORACLE_SQL = {
    "op1_license_scan": license_scan.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_suffix_array_dedup": suffix_dedup.ORACLE_SQL,
    "op7_warc_revisits": warc.ORACLE_SQL,
    "op8_source_mixing": mixing.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
}
