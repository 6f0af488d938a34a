"""op8: near duplicates of `documents` on 4-word shingles. SQL cannot express the search on
whole tables in reasonable time; tests/llm/test_minhash.py holds it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlake.llm.minhash import MinHash, near_duplicates
from barlake.llm.text import read_table

PARAMS = MinHash(shingle=4, percent=80)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), params=PARAMS)


QUERIES = {"op8_minhash_near_dedup": op8_minhash_near_dedup}
