"""Queries of the corpus operators and, where SQL expresses them, their oracles."""

from __future__ import annotations

from . import binary_records, containment, language_id, line_quality, merkle_fixity, minhash_dedup, packing, secret_scan, sparse_suffix, toxicity

QUERIES = {
    "op1_line_crf": line_quality.op1_line_crf,
    "op2_minhash_odd_sketch": minhash_dedup.op2_minhash_odd_sketch,
    "op3_binary_records": binary_records.op3_binary_records,
    "op4_cross_parsing": language_id.op4_cross_parsing,
    "op5_sparse_suffix": sparse_suffix.op5_sparse_suffix,
    "op6_merkle_fixity": merkle_fixity.op6_merkle_fixity,
    "op7_secret_cnn": secret_scan.op7_secret_cnn,
    "op8_kneser_ney": toxicity.op8_kneser_ney,
    "op9_containment": containment.op9_containment,
    "op10_harmonic_packing": packing.op10_harmonic_packing,
}
ORACLES: dict[str, str] = {"op9_containment": containment.ORACLE}
