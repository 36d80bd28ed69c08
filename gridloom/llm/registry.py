"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import addressable, htmlcrf, mixing, partenum, pieces, pitmanyor, quality, topk, winnowing, wordpieces

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_token_files": addressable.op1_token_files,
        "op2_jaccard_join": partenum.op2_jaccard_join,
        "op3_lm_scores": pitmanyor.op3_lm_scores,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_quality": quality.op5_quality,
        "op6_token_counts": wordpieces.op6_token_counts,
        "op7_exact_topk": topk.op7_exact_topk,
        "op8_fingerprints": winnowing.op8_fingerprints,
        "op9_html_text": htmlcrf.op9_html_text,
        "op10_sentencepiece": pieces.op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": partenum.ORACLE, "op4_mix_sources": mixing.ORACLE, "op7_exact_topk": topk.ORACLE}
