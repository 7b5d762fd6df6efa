"""The queries of the text operators, and SQL for those that SQL can express on whole tables."""

from millrace.llm import byte_bpe, centroids, decontamination, html_text, jaccard_join, language_id, licenses, line_dedup, pii, quality, spelling, token_counts, vector_topk

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_language_id": language_id.op3_language_id,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_vector_topk": vector_topk.op8_vector_topk,
    "op9_pii": pii.op9_pii,
    "op10_html_text": html_text.op10_html_text,
    "op11_centroids": centroids.op11_centroids,
    "op12_licenses": licenses.op12_licenses,
    "op13_spelling": spelling.op13_spelling,
}
ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op5_decontamination": decontamination.ORACLE_SQL,
    "op7_jaccard_join": jaccard_join.ORACLE_SQL,
    "op8_vector_topk": vector_topk.ORACLE_SQL,
    "op11_centroids": centroids.ORACLE_SQL,
    "op12_licenses": licenses.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
