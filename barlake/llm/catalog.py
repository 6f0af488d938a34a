"""Queries of the training-data operators: name -> builder, and SQL where it can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from barlake.session import ship_package


def _shipped(fn):
    @functools.wraps(fn)
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    return build


def _modules():
    from barlake.llm import (q_chat, q_decontaminate, q_line_dedup, q_minhash, q_packing, q_periodic, q_quality, q_spelling,
                             q_token_count, q_topk, q_toxicity, q_url_filter, q_warc)
    return (q_chat, q_decontaminate, q_line_dedup, q_minhash, q_packing, q_periodic, q_quality, q_spelling,
            q_token_count, q_topk, q_toxicity, q_url_filter, q_warc)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(fn) for m in _modules() for name, fn in m.QUERIES.items()} | {"pipeline": _shipped(corpus_pipeline.run)}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "ORACLES", {}).items()}
