"""op2: toxicity of every document. A trained network has no SQL; tests/llm/test_toxicity.py
checks held-out accuracy and the scoring against a plain loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlake.llm.text import read_table
from barlake.llm.toxicity import ToxicNet, toxicity

PARAMS = ToxicNet()


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), params=PARAMS)


QUERIES = {"op2_toxicity": op2_toxicity}
