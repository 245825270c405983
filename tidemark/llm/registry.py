"""Queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontamination, html_extraction, jaccard_join, language_id, merkle, multi_index, quality, runs, sharding, toxicity, url_filter, warc


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_decontamination": decontamination.op2_decontamination,
        "op8_language_id": language_id.op8_language_id,
        "op9_bpe": bpe.op9_bpe,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op3_multi_index": multi_index.op3_multi_index,
        "op7_warc": warc.op7_warc,
        "op4_html_extraction": html_extraction.op4_html_extraction,
        "pipeline": _pipeline,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_sharding": sharding.op6_sharding,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_quality_rules": quality.op12_quality_rules,
        "op13_periodic_runs": runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontamination.ORACLE,
        "op5_url_filter": url_filter.ORACLE,
        "op11_merkle_manifest": merkle.ORACLE,
        "op6_sharding": sharding.ORACLE,
        "op7_warc": warc.ORACLE,
    }
