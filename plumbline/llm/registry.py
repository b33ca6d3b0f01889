"""Queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.audit import audit_sql, op12_filter_audit
from plumbline.llm.codes import op13_vector_codes
from plumbline.llm.importance import op1_importance
from plumbline.llm.language import op9_language_id
from plumbline.llm.licences import op8_licences, scan_sql
from plumbline.llm.neighbours import op11_neighbours
from plumbline.llm.packing import op10_packing
from plumbline.llm.passages import op4_passages
from plumbline.llm.pieces import op7_sentencepiece
from plumbline.llm.private import op3_private_data
from plumbline.llm.quality import op6_quality_rules, rules_sql
from plumbline.llm.simhash import op2_simhash
from plumbline.llm.spotsigs import op5_spotsigs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance": op1_importance,
    "op2_simhash": op2_simhash,
    "op3_private_data": op3_private_data,
    "op4_passages": op4_passages,
    "op5_spotsigs": op5_spotsigs,
    "op6_quality_rules": op6_quality_rules,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_licences": op8_licences,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_neighbours": op11_neighbours,
    "op12_filter_audit": op12_filter_audit,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {
    "op6_quality_rules": rules_sql(),
    "op8_licences": scan_sql(),
    "op12_filter_audit": audit_sql(),
}
