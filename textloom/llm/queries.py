"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import chat, decontam, encoding, jaccard, langid, lm, oddsketch, oracles, packing, pii, quality, repair, secrets, suffixes

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_chat_formatting": lambda s, d: chat.op1(table(s, d, "conversations")),
        "op2_secret_scan": lambda s, d: secrets.op2(table(s, d, "documents")),
        "op3_suffix_dedup": lambda s, d: suffixes.op3(table(s, d, "documents")),
        "op4_language_id": lambda s, d: langid.op4(table(s, d, "documents")),
        "op5_quality_rules": lambda s, d: quality.op5(table(s, d, "documents"), table(s, d, "labels")),
        "op6_ngram_jaccard": lambda s, d: jaccard.op6(table(s, d, "documents")),
        "op7_decontamination": lambda s, d: decontam.op7(table(s, d, "documents"), table(s, d, "benchmark")),
        "op8_pii": lambda s, d: pii.op8(table(s, d, "documents")),
        "op9_lm_scoring": lambda s, d: lm.op9(table(s, d, "documents")),
        "op10_best_fit_packing": lambda s, d: packing.op10(table(s, d, "documents")),
        "op11_odd_sketches": lambda s, d: oddsketch.op11(table(s, d, "documents")),
        "op12_structure_repair": lambda s, d: repair.op12(table(s, d, "conversations")),
        "op13_target_encoding": lambda s, d: encoding.op13(*(table(s, d, x) for x in ("sale_lines", "sales", "items", "vendors", "clients"))),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_ngram_jaccard": oracles.near_duplicates(3, 90),
        "op11_odd_sketches": oracles.near_duplicates(3, 85, ", doc_id = least AS kept"),
        "op12_structure_repair": oracles.repair(),
        "op13_target_encoding": oracles.encoding(),
    }
