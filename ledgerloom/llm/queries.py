"""The queries of the training-data operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.chat import OP3_SQL, op3_chat
from ledgerloom.llm.filter_audit import OP12_SQL, op12_filter_audit
from ledgerloom.llm.fingerprints import op6_fingerprints
from ledgerloom.llm.language import op9_language
from ledgerloom.llm.mixing import op8_mixing
from ledgerloom.llm.neighbours import op7_neighbours
from ledgerloom.llm.ngram_join import OP2_SQL, op2_ngram_join
from ledgerloom.llm.packing import op4_packing
from ledgerloom.llm.quality import op5_quality
from ledgerloom.llm.repair import op11_repair
from ledgerloom.llm.secrets import op10_secrets
from ledgerloom.llm.toxicity import op1_toxicity
from ledgerloom.llm.windows import op13_windows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_chat": op3_chat,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_fingerprints": op6_fingerprints,
    "op7_neighbours": op7_neighbours,
    "op8_mixing": op8_mixing,
    "op9_language": op9_language,
    "op10_secrets": op10_secrets,
    "op11_repair": op11_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_windows": op13_windows,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": OP2_SQL,
    "op3_chat": OP3_SQL,
    "op12_filter_audit": OP12_SQL,
}
