"""The registered queries of the training-data operators and the SQL that some of them are checked against."""

from __future__ import annotations

from tidemark.llm import (
    chat_format, code_vectors, decontamination, exact_topk, language_id, license_scan, line_dedup, mixing, near_dedup, neighbour_forest, pii, secret_scan, token_alignment,
)

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_exact_topk": exact_topk.op3_exact_topk,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_pii": pii.op9_pii,
    "op10_source_mixing": mixing.op10_source_mixing,
    "op11_nearest_neighbours": neighbour_forest.op11_nearest_neighbours,
    "op12_vector_codes": code_vectors.op12_vector_codes,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLES = {
    "op2_decontamination": decontamination.ORACLE_SQL,
    "op3_exact_topk": exact_topk.ORACLE_SQL,
    "op4_near_dedup": near_dedup.ORACLE_SQL,
    "op5_license_scan": license_scan.ORACLE_SQL,
    "op8_chat_format": chat_format.ORACLE_SQL,
    "op10_source_mixing": mixing.ORACLE_SQL,
    "op12_vector_codes": code_vectors.ORACLE_SQL,
}
