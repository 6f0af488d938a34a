"""op13: spelling variants of the words of `documents`, with a letter of some occurrences deleted.
SQL is too slow on whole tables; tests/llm/test_spelling.py holds the query against brute force."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from barlake.llm.spelling import Spelling, spelling_variants
from barlake.llm.text import read_table

PARAMS = Spelling()


def misspelt(doc_id, word: str) -> str:
    """The word, without one of its letters if 31 divides the crc32 of ``doc_id:word`` (null id: never)."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 31:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1:]


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"), params=PARAMS, rewrite=misspelt)


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
