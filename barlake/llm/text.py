"""Helpers of the text operators: word hashing, shingles, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64

#: ASCII white space of the word rule `[^\x20\x09-\x0D]+`: exactly what bytes.split() cuts at.
#: bytes.lower() touches A-Z only, so both work on UTF-8 without decoding.


def tune(spark: SparkSession) -> None:
    """Arrow batches of few rows: texts are long, and a batch must stay a few MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def slices(batches, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most max_bytes of text each, or of a single row.

    Very long texts therefore never stand beside others in one work unit.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = np.diff(offsets_of(batch.column(column)))
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        yield batch.slice(start)


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary column (nulls have length 0)."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text, null as None."""
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered up to a bound and then begun anew."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


_HELD: dict = {}


def held(key, make):
    """What a worker process keeps from task to task, for one operator at a time: a worker that
    Spark reuses for another operator lets go of the former one's memory."""
    if key not in _HELD:
        _let_go()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Lets go of what this worker process keeps; operators that keep nothing begin with it."""
    if _HELD:
        _let_go()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def _let_go() -> None:
    """A worker's next operator finds the memory of the former one, and so do the other processes of
    its executor."""
    _HELD.clear()
    give_back()


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of `width` consecutive word hashes, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    base = U64(0x9E3779B97F4A7C15)
    for j in range(width):
        total = total * base + hashes[j:j + n]
    return mix64(total ^ U64(width))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, an empty one none."""
    if len(hashes) == 0:
        return np.zeros(0, U64)
    return np.unique(rolled(hashes, min(width, len(hashes))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
