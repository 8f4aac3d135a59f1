"""The queries of this subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidelane.llm import op1_neighbours, op2_token_counts, op3_url_filters, op4_decontamination, op5_toxicity, op6_mixing, op7_language_id, op8_html_extraction, op9_license_scan, op10_ngram_join

MODULES = (op1_neighbours, op2_token_counts, op3_url_filters, op4_decontamination, op5_toxicity, op6_mixing, op7_language_id, op8_html_extraction, op9_license_scan, op10_ngram_join)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
