"""Queries over the driver's tables, one per operator, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import (alignment, binary, conversation, embedding, html_extract, licenses, line_dedup, mixing, packing, pii, quality_knn,
                           quality_rules, simhash)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_quality_classifier": quality_knn.op2_quality_classifier,
    "op3_mixing": mixing.op3_mixing,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_token_binary": binary.op6_token_binary,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_packing": packing.op9_packing,
    "op10_embedding_near_dedup": embedding.op10_embedding_near_dedup,
    "op11_html_extraction": html_extract.op11_html_extraction,
    "op12_conversation_repair": conversation.op12_conversation_repair,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op7_quality_rules": quality_rules.oracle(),
}
