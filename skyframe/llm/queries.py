"""Queries over the corpus tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyframe.llm.op1_jaccard_join import OP1_SQL, op1_jaccard_join
from skyframe.llm.op2_license_scan import op2_license_scan
from skyframe.llm.op3_decontamination import op3_decontamination
from skyframe.llm.op4_substring_dedup import op4_substring_dedup
from skyframe.llm.op5_suffix_dedup import op5_suffix_dedup
from skyframe.llm.op6_toxicity import op6_toxicity
from skyframe.llm.op7_packing import op7_packing
from skyframe.llm.op8_top_k import OP8_SQL, op8_top_k
from skyframe.llm.op9_language_id import op9_language_id
from skyframe.llm.op10_url_filter import OP10_SQL, op10_url_filter
from skyframe.llm.op11_conversation_trie import OP11_SQL, op11_conversation_trie
from skyframe.llm.op12_filter_audit import OP12_SQL, op12_filter_audit
from skyframe.llm.op13_sharding import OP13_SQL, op13_sharding

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_license_scan": op2_license_scan,
        "op3_decontamination": op3_decontamination,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_packing": op7_packing,
        "op8_top_k": op8_top_k,
        "op9_language_id": op9_language_id,
        "op10_url_filter": op10_url_filter,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_filter_audit": op12_filter_audit,
        "op13_sharding": op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": OP1_SQL, "op8_top_k": OP8_SQL, "op10_url_filter": OP10_SQL, "op11_conversation_trie": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_sharding": OP13_SQL}
