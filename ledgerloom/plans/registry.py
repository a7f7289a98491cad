"""All queries of the record-processing part, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import queries as Q
from ledgerloom.plans.oracles import ORACLE_SQL

NAMES = (
    "website_derive", "email_extract", "account_number_scan", "normalize_chain", "corporate_names", "ifsc_repair", "width_fit", "doc_classify", "type_counts", "validator_suite",
    "validator_counts", "pin_state_check", "gstin_pan_fallback", "synthetic_layout", "neighbours", "line_clusters", "char_sessionize", "page_trust", "candidate_score", "validation_bias", "choose_best",
    "pattern_only_anti", "canonical_pivot", "packet_summary", "review_flags", "cross_doc_consistency", "lookup_state_city", "records_page", "find_duplicates", "unique_violations",
    "patch_records", "delete_records", "upsert_records", "mark_pushed", "erp_payload", "verify_cells", "eval_outcomes", "address_block", "label_similarity", "gap_groups", "caption_match", "address_resolve",
    "address_segment", "record_insert", "payloads", "customer_form", "back_fill", "address_eval", "sheet_fill",
    "word_break", "address_lines", "extract_packets", "lookup_build", "city_build", "caption_cleanup", "block_layout", "eval_report", "nested_result",
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: getattr(Q, n) for n in NAMES}

__all__ = ["ORACLE_SQL", "QUERIES"]
