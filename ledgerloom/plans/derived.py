"""Deterministic inputs for the record queries, derived from the supplier table.

The expressions are SQL that Spark and DuckDB read alike, so both sides start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = "s_suppkey"
VENDOR = {
    "packet_id": K,
    "vendor_name": f"s_name || CASE WHEN {K} % 4 = 0 THEN ' pvt ltd' WHEN {K} % 4 = 1 THEN ' Private LIMITED' ELSE '' END",
    "gst_number": f"CASE WHEN {K} % 17 = 0 THEN NULL ELSE CASE WHEN {K} % 11 = 0 THEN '99' ELSE lpad(CAST(s_nationkey + 1 AS STRING), 2, '0') END || 'ABCDE' || lpad(CAST({K} % 10000 AS STRING), 4, '0') || 'F1' || CASE WHEN {K} % 7 = 0 THEN 'X' ELSE 'Z' END || '5' END",
    "pan": f"CASE WHEN {K} % 5 = 0 THEN 'ABCDE9999Z' WHEN {K} % 13 = 0 THEN '' WHEN {K} % 19 = 0 THEN 'abc' ELSE 'ABCDE' || lpad(CAST({K} % 10000 AS STRING), 4, '0') || 'F' END",
    "pin_code": f"CASE WHEN {K} % 6 = 0 THEN '012345' ELSE CAST(100000 + {K} * 37 % 900000 AS STRING) END",
    "state": f"CASE WHEN {K} % 3 = 0 THEN 'West Bengal' WHEN {K} % 3 = 1 THEN 'kerala ' ELSE 'Atlantis' END",
    "country": f"CASE WHEN {K} % 10 = 9 THEN 'Narnia' ELSE 'India' END",
    "email": f"CASE WHEN {K} % 8 = 0 THEN 'not an address' WHEN {K} % 4 = 1 THEN 'Info@gmail.com' ELSE 'info@vendor' || CAST({K} AS STRING) || '.co.in' END",
    "telephone": f"CAST(CASE WHEN {K} % 9 = 0 THEN 5000000000 ELSE 9000000000 END + {K} AS STRING)",
    "ifsc": f"CASE WHEN {K} % 2 = 0 THEN 'SBIN0' ELSE '5b1no' END || lpad(CAST({K} % 1000000 AS STRING), 6, '0')",
    "account_number": f"CAST({K} * 1000003 % 1000000000000 AS STRING)",
    "address_1": f"'Plot ' || CAST({K} AS STRING) || ', Industrial Estate Phase ' || CAST({K} % 4 AS STRING) || ', Near The Old Water Tower'",
    "address_2": f"CASE WHEN {K} % 3 = 0 THEN '' ELSE 'Sector ' || CAST({K} % 90 AS STRING) END",
    "address_3": f"CASE WHEN {K} % 5 = 0 THEN NULL ELSE 'Village Road Number ' || CAST({K} % 700 AS STRING) || ' Extension Layout' END",
    "city": "'City' || CAST(s_nationkey AS STRING)",
}
VENDOR_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in VENDOR.items()) + " FROM supplier"

N = "n"
CANDIDATE = {
    "packet_id": K,
    "field": f"CASE WHEN {N} < 6 THEN 'vendor_name' ELSE 'gst_number' END",
    "cand_ord": N,
    "value": f"CASE WHEN ({K} + {N}) % 9 = 0 THEN '' WHEN ({K} + {N}) % 11 = 0 THEN 'Micro' ELSE 'V' || CAST(({K} + {N} % 4) % 50 AS STRING) || CASE WHEN {N} % 5 = 0 THEN '' ELSE ' Trading House' END END",
    "doc_id": f"{N} % 3",
    "doc_type": f"CASE {N} % 3 WHEN 0 THEN 'cancelled_cheque' WHEN 1 THEN 'gst_certificate' ELSE 'udyam_certificate' END",
    "kind": f"CASE ({K} + {N}) % 4 WHEN 0 THEN 'inline' WHEN 1 THEN 'adjacent_same_line' WHEN 2 THEN 'adjacent' ELSE 'pattern_only' END",
    "label_similarity": f"(({K} * 7 + {N} * 13) % 20) / 20",
    "proximity": f"(({K} * 3 + {N} * 5) % 10) / 10",
    "ocr_confidence": f"(80 + ({K} + {N}) % 20) / 100",
    "has_pattern": f"{N} >= 6",
    "matched": f"{N} >= 6 AND ({K} + {N}) % 5 <> 0",
    "expected_doc": f"CASE WHEN {K} % 4 = 0 THEN NULL ELSE {N} % 3 <> 0 END",
    "label_like": f"({K} + {N}) % 7 = 0",
    "foreign": f"({K} * 5 + {N}) % 8 = 0",
    "is_text": f"{N} < 6",
    "status": f"CASE ({K} + 2 * {N}) % 5 WHEN 0 THEN 'invalid' WHEN 1 THEN 'warning' WHEN 2 THEN 'valid' END",
}
CANDIDATE_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in CANDIDATE.items()) + " FROM supplier, (SELECT unnest(range(12)) AS n) AS r"


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(*[f"{v} AS {k}" for k, v in VENDOR.items()])


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve candidates per supplier: six of a name, six of a number."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("*", "explode(sequence(0, 11)) AS n")
    return rows.selectExpr(*[f"{v} AS {k}" for k, v in CANDIDATE.items()])
