"""op10: all documents packed into sequences of 2048 tokens; rows digested from the packed ids.
SQL cannot express tokenisation; tests/llm/test_packing.py checks the exact round trip."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barlake.llm.packing import Packing, packed
from barlake.llm.text import offsets_of, read_table

PARAMS = Packing(capacity=2048, end_id=1)


SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint")


def _digested(keep_ids: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            crc = [zlib.crc32(x.as_buffer()) for x in ids]
            length = np.diff(offsets_of(ids)) // 4
            cols = {"doc_id": batch.column("doc_id"), "start": batch.column("start"), "length": pa.array(length),
                    "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": batch.column("doc_tokens"),
                    "sequence_id": batch.column("sequence_id"), "offset": batch.column("seq_offset")}
            if keep_ids:
                cols["ids"] = ids
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def digest(pieces: DataFrame, keep_ids: bool = False) -> DataFrame:
    """The columns of the query from :func:`packed`, and the ids themselves (binary) where they are wanted."""
    return pieces.mapInArrow(_digested(keep_ids), SCHEMA + ", ids binary" * keep_ids)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), params=PARAMS))


QUERIES = {"op10_packing": op10_packing}
