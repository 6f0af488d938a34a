"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into units whose tokens are independent of their surroundings. The units a
worker has not met yet are cut into pre-tokens and held, all together, as one ragged array
of symbols. In each round every pre-token applies its own lowest-rank pair everywhere it
occurs, at once for all of them; finished pre-tokens leave the array. What survives is
counted. Counts of units are remembered per worker, up to a bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlake.llm.pretokens import PLAIN, PRETOKEN, UNIT, byte_alphabet, read_vocabulary
from barlake.llm.text import held, offsets_of, slices, tune

NONE = np.int32(np.iinfo(np.int32).max)


class Merges:
    """Merge ranks in an open-addressing table: (left id << 32 | right id) -> rank, merged id."""

    def __init__(self, path: str):
        spec = read_vocabulary(path)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs] + [0], np.int32)
        self.of_byte = np.array([vocab[c] for c in byte_alphabet()], np.int32)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.bits = max(8, int(len(pairs) * 4).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        key, rank = left << 32 | right, np.arange(len(pairs), dtype=np.int32)
        at = self._slot(key)
        self.probes = 0
        while len(key):  # the first comer takes a free slot, the others look one further
            self.probes += 1
            free = self.key[at] == -1
            _, first = np.unique(at, return_index=True)
            takes = np.zeros(len(key), bool)
            takes[first] = True
            takes &= free
            self.key[at[takes]], self.rank[at[takes]] = key[takes], rank[takes]
            key, rank, at = key[~takes], rank[~takes], (at[~takes] + 1) & (len(self.key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the vocabulary does not merge it."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        held = self.key[at]
        rank = np.where(held == key, self.rank[at], NONE)
        left_over = np.flatnonzero((held != key) & (held != -1))
        for _ in range(self.probes):
            if not len(left_over):
                break
            at[left_over] = (at[left_over] + 1) & (len(self.key) - 1)
            slot = at[left_over]
            held, want = self.key[slot], key[left_over]
            found = held == want
            rank[left_over[found]] = self.rank[slot[found]]
            left_over = left_over[~found & (held != -1)]
        return rank

    def survivors(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols left of each non-empty piece once no pair can be merged."""
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.flatnonzero(counts > 1)
        if not len(owner):
            return counts
        size = counts[owner]
        sym = self.of_byte[np.frombuffer(b"".join(pieces[i] for i in owner), np.uint8)]
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = self.find(sym[:-1], sym[1:])
        rank[np.cumsum(size) - 1] = NONE
        while True:
            lowest = np.minimum.reduceat(rank, np.cumsum(size) - size)
            done = lowest == NONE
            if done.any():  # finished pieces leave the array
                counts[owner[done]] = size[done]
                stay = np.repeat(~done, size)
                sym, rank = sym[stay], rank[stay]
                owner, size, lowest = owner[~done], size[~done], lowest[~done]
                if not len(owner):
                    return counts
            last = np.cumsum(size) - 1
            hit = self._leftmost(np.flatnonzero(rank == np.repeat(lowest, size)))
            sym[hit] = self.made[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            size = size - np.bincount(np.searchsorted(last, hit), minlength=len(owner))
            merged = hit - np.arange(len(hit))  # where the merged symbols stand now
            sym, rank = sym[stay], rank[stay]
            last = np.cumsum(size) - 1
            # a merged symbol's pair and the pair before it are new
            at = np.concatenate([merged, merged[merged > 0] - 1])
            at = at[at < len(sym) - 1]
            rank[at] = self.find(sym[at], sym[at + 1])
            rank[last] = NONE

    @staticmethod
    def _leftmost(at: np.ndarray) -> np.ndarray:
        """Of overlapping hits (a a a), every second one of a run, from its left end."""
        near = np.diff(at) == 1
        if not near.any():
            return at
        run = np.concatenate([[0], np.cumsum(~near)])
        first = np.flatnonzero(np.concatenate([[True], ~near]))
        return at[(np.arange(len(at)) - first[run]) % 2 == 0]


class UnitCounts(dict):
    """unit -> number of tokens; begun anew beyond `limit` units. An unknown unit counts 0
    at first and is noted, so that all unknown units of a batch are merged together."""

    def __init__(self, merges: Merges, limit: int = 500_000):
        super().__init__()
        self.merges, self.limit, self.unknown = merges, limit, []

    def __missing__(self, unit: str) -> int:
        self.unknown.append(unit)
        return 0

    def learned(self, units: set[str]) -> dict[str, int]:
        new = list(units)
        pieces, ends = [], []
        for unit in new:
            if PLAIN(unit):
                pieces.append(unit.encode())
            else:
                pieces += [p.encode() for p in PRETOKEN.findall(unit)]
            ends.append(len(pieces))
        total = np.concatenate([[0], np.cumsum(self.merges.survivors(pieces))])
        return dict(zip(new, np.diff(total[np.concatenate([[0], ends])]).tolist()))

    def count(self, texts: list[str]) -> list[int]:
        get, counts, ends = self.__getitem__, [], []
        self.unknown = []
        for text in texts:
            sections, n = [text], 0
            for s in self.merges.special:  # its string in a text is one token and cuts it
                if s in text:
                    sections = [x for part in sections for x in part.split(s)]
            for x in sections:
                n += sum(map(get, UNIT.findall(x)))
            counts.append(n + len(sections) - 1)
            ends.append(len(self.unknown))
        if self.unknown:
            new = self.learned(set(self.unknown))
            start = 0
            for i, end in enumerate(ends):
                counts[i] += sum(map(new.__getitem__, self.unknown[start:end]))
                start = end
            if len(self) + len(new) > self.limit:
                self.clear()
            self.update((u, n) for u, n in new.items() if len(u) <= 64)
        return counts


def _counting(shared):
    key = shared._jbroadcast.id()

    def run(batches):
        memo = held(("token count", key), lambda: UnitCounts(shared.value))
        for batch in slices(batches, "text", 2 << 20):
            text = batch.column(1)
            tokens = memo.count([t or "" for t in text.to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets_of(text))), pa.array(tokens, pa.int64())],
                names=["id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """UTF-8 bytes and tokens of every whole text: ``id_col, n_bytes, n_tokens, over_limit``.

    ``vocabulary`` is a byte-level BPE file (.json of the tokenizers library) that the driver
    reads; the merge arrays (about 1 MB for 50,000 merges) are broadcast. Special strings
    inside a text are one token each, as that library has it by default. No shuffle: one row
    in, one row out, in bounded memory. A null or empty text has 0 bytes and 0 tokens; ids
    may be null or repeat; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(Merges(vocabulary))
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(_counting(shared), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
