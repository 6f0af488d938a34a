"""Training-corpus pipeline: five stages over `documents`, each written before the next reads it.

toxicity -> line dedup -> MinHash near-dedup -> benchmark decontamination -> packing. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barlake.llm.decontaminate import Decontamination, decontaminate
from barlake.llm.line_dedup import LineDedup, dedup_lines
from barlake.llm.minhash import MinHash, near_duplicates
from barlake.llm.packing import Packing, packed
from barlake.llm.q_packing import digest
from barlake.llm.text import read_table
from barlake.llm.toxicity import ToxicNet, toxicity
from barlake.session import ship_package, written

VOCABULARY = "byte_bpe_50k.json"


def _counted(docs: DataFrame, changed) -> DataFrame:
    """n_chars of the texts that a stage has changed."""
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language. Null ids cannot be rejected."""
    ship_package(spark)
    return _without(docs, toxicity(docs, read_table(spark, sf_dir, "labels"), params=ToxicNet()).where("rejected"))


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated three-line windows left in their first place only."""
    ship_package(spark)
    return _counted(dedup_lines(docs, params=LineDedup()), F.col("n_removed") > 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    ship_package(spark)
    return _without(docs, near_duplicates(docs, params=MinHash(shingle=5, percent=80)).where("not kept"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark go whole."""
    ship_package(spark)
    before = docs.withColumn("_length", F.length("text"))
    clean = decontaminate(before, read_table(spark, sf_dir, "benchmark"), params=Decontamination())
    return _counted(clean, F.length("text") != F.col("_length")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 2048."""
    ship_package(spark)
    return digest(packed(docs, public_tokenizers.path(VOCABULARY), params=Packing()), keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_passages), ("near_dedup", drop_near_duplicates),
          ("decontamination", remove_benchmark), ("packing", pack_sequences)]

#: Trained scores and tokens have no SQL; tests/llm/test_pipeline.py checks each stage's effect.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
