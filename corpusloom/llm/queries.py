"""The training-data queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import chat, packing, pieces, quality, simhash, suffix, topk, toxicity, warc, wrapper

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_exact_top_k": topk.op4_exact_top_k,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_suffix_array": suffix.op8_suffix_array,
    "op9_warc": warc.op9_warc,
    "op10_html_wrapper": wrapper.op10_html_wrapper,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat.SQL,
    "op2_quality_rules": quality.SQL,
    "op4_exact_top_k": topk.SQL,
}
