"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontaminate, mixing
from tracewright.llm.ann import op8_kmeans_tree_ann
from tracewright.llm.ctw import op6_ctw_scores
from tracewright.llm.decontaminate import op1_decontamination
from tracewright.llm.html_text import op3_html_mincut
from tracewright.llm.langid import op7_language_id
from tracewright.llm.mixing import op5_pfair_mixing
from tracewright.llm.simhash import op2_simhash_near_dedup
from tracewright.llm.sstable import op4_token_sstable
from tracewright.llm.substring import op9_substring_dedup
from tracewright.llm.toxicity import op10_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_html_mincut": op3_html_mincut,
        "op4_token_sstable": op4_token_sstable,
        "op5_pfair_mixing": op5_pfair_mixing,
        "op6_ctw_scores": op6_ctw_scores,
        "op7_language_id": op7_language_id,
        "op8_kmeans_tree_ann": op8_kmeans_tree_ann,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.ORACLE_SQL,
        "op5_pfair_mixing": mixing.ORACLE_SQL,
    }
