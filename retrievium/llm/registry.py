"""The training-data queries and their SQL, by contract name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitsliced, chat, decontaminate, langid, lines, ordermin, packing, pii, repeats, wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": langid.op1,
    "op2_order_minhash": ordermin.op2,
    "op3_line_dedup": lines.op3,
    "op4_chat_format": chat.op4,
    "op5_html_extraction": wrappers.op5,
    "op6_bitsliced_topk": bitsliced.op6,
    "op7_suffix_dedup": repeats.op7,
    "op8_decontamination": decontaminate.op8,
    "op9_pii": pii.op9,
    "op10_best_fit_packing": packing.op10,
}
SQL: dict[str, str] = {"op3_line_dedup": lines.SQL, "op6_bitsliced_topk": bitsliced.SQL, "op7_suffix_dedup": repeats.SQL, "op8_decontamination": decontaminate.SQL}
