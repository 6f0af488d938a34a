"""op6: tokens of every document under a byte-level BPE vocabulary. SQL cannot express merges;
tests/llm/test_token_count.py holds the counts against the tokenizers library."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barlake.llm.text import read_table
from barlake.llm.token_count import token_counts


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op6_token_counts": op6_token_counts}
