"""Periodic runs of words, by online dyadic square catching.

A text is read as a sequence of words. A *run* of period q is a maximal stretch in which
words q apart are equal, q being its smallest period. Catchers stand over completed blocks
of 2^k words: a stretch of period 2^(k+1) <= q < 2^(k+2) that is at least 2q long has a
whole block, aligned to 2^k, in its first half, and sees it again q words later. So with
every appended word the suffix of 2^k words is compared with the two catchers whose blocks
began 2^(k+1) to 2^(k+2)-1 words before it: two comparisons for each word and level,
O(n log n) for a text, whatever it repeats. Squares caught at one distance by neighbouring
blocks are one stretch; it is extended by less than a block on each side, compared with the
words themselves, and dropped if a run of a smaller period holds it.

The words of a work unit (several texts with marks between them that equal nothing) are
appended together: the comparisons of a level are two array expressions, so memory is a few
arrays of the unit's words, not one for each level.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlake.llm.text import U64, as_bytes, mix64, release, slices, tune

FACTOR = U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Periodic:
    min_length: int = 6    # words of the shortest run
    exponent: int = 4      # a run is at least exponent * period long
    unit_bytes: int = 2 << 20  # text appended together, or one longer text

    def __post_init__(self):
        if self.exponent < 2:
            raise ValueError("exponent must be at least 2: a run holds a square")

    def shortest(self, period: int) -> int:
        return max(self.min_length, self.exponent * period)


class Catchers:
    """Runs of a sequence of integers; unequal marks between texts keep runs apart."""

    def __init__(self, params: Periodic):
        self.params = params
        self.starts, self.ends, self.periods = ([np.zeros(0, np.int64)] for _ in range(3))

    def runs(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end, period by start and period. lengths: words of the texts, longest text first;
        each text is followed by one mark. Texts too short for a level's periods take no part in it."""
        total = np.cumsum(lengths + 1)
        self._stretches(ids, np.flatnonzero(ids[1:] == ids[:-1]), 1)
        level, hashes = 0, mix64(ids.astype(U64) + U64(1))
        while True:
            block, low = 1 << level, 2 << level
            texts = np.searchsorted(-lengths, -self.params.shortest(low), side="right")
            if texts == 0:
                break
            n = int(total[texts - 1])
            self._level(ids[:n], hashes[:n], block, low)
            grown = hashes[:n] * FACTOR  # hash of 2^(k+1) words from those of its halves
            grown[:n - block] += hashes[block:n]
            grown[n - block:] += mix64(np.arange(n - block, n, dtype=U64) + (U64(1 + level) << U64(48)))
            hashes, level = grown, level + 1
        start, end, period = (np.concatenate(x) for x in (self.starts, self.ends, self.periods))
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]

    def _level(self, ids: np.ndarray, hashes: np.ndarray, block: int, low: int) -> None:
        """Squares of the periods low to 2 * low - 1, from blocks of low / 2 words."""
        rows = -(-len(hashes) // block)
        table = np.concatenate([hashes, mix64(np.arange(rows * block - len(hashes), dtype=U64) + (U64(3) << U64(50)))]).reshape(rows, block)
        # a run of L words equals itself shifted over L - q words, which hold so many whole blocks
        stretch = max(self.params.min_length - (2 * low - 1), (self.params.exponent - 1) * low)
        need = max(1, (stretch - block + 1) // block)
        for half in (2, 3):  # the catcher's block began half * block to half * block + block - 1 words ago
            if rows - half < need:
                continue
            caught = table[half:] == table[:-half, :1]
            chain = caught
            have = 1
            while have < need:  # `need` neighbouring catchers at one distance, by doubling
                step = min(have, need - have)
                if len(chain) <= step:
                    chain = chain[:0]
                    break
                chain = chain[:-step] & chain[step:]
                have += step
            if not chain.any():
                continue
            column, row = np.nonzero(chain.T)
            new = np.flatnonzero(np.concatenate([[True], (np.diff(column) != 0) | (np.diff(row) != 1)]))
            last = np.concatenate([new[1:], [len(row)]]) - 1
            first_word, period = row[new] * block, half * block + column[new]
            end_word = (row[last] + need) * block  # equality holds for words before it, at least
            if need >= 4:  # long enough to be told from a run of a smaller period (Fine and Wilf)
                free = ~self._inside(first_word, end_word + period)
                first_word, end_word, period = first_word[free], end_word[free], period[free]
            self._merge(ids, first_word, end_word, period, block)

    def _inside(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a known run, all of them of smaller period, holds words start to end."""
        known, ends = np.concatenate(self.starts), np.concatenate(self.ends)
        if not len(known):
            return np.zeros(len(start), bool)
        order = np.argsort(known, kind="stable")
        reach = np.maximum.accumulate(ends[order])
        at = np.searchsorted(known[order], start, side="right") - 1
        return (at >= 0) & (reach[np.maximum(at, 0)] >= end)

    def _merge(self, ids, first, end, period, block) -> None:
        """Extends each stretch of equal words by up to a block and keeps the new runs."""
        found = []
        for a, b, q in zip(first.tolist(), end.tolist(), period.tolist()):
            left = max(0, a - block)
            apart = np.flatnonzero(ids[left:a] != ids[left + q:a + q])
            a = left + int(apart[-1]) + 1 if len(apart) else left
            right = min(len(ids) - q, b + block)
            apart = np.flatnonzero(ids[b:right] != ids[b + q:right + q])
            b = b + int(apart[0]) if len(apart) else right
            if b + q - a >= self.params.shortest(q) and np.array_equal(ids[a:b], ids[a + q:b + q]):
                found.append((a, b + q, q))
        self._keep(found)

    def _stretches(self, ids, equal, q) -> None:
        """Runs of period 1: the positions where a word equals the next one, in a row."""
        if not len(equal):
            return
        new = np.flatnonzero(np.concatenate([[True], np.diff(equal) != 1]))
        last = np.concatenate([new[1:], [len(equal)]]) - 1
        found = [(a, b + 1 + q, q) for a, b in zip(equal[new].tolist(), equal[last].tolist()) if b + 1 + q - a >= self.params.shortest(q)]
        self._keep(found)

    def _keep(self, found: list[tuple[int, int, int]]) -> None:
        """Runs of one level: none holds another of its multiples, so only smaller levels can hold them."""
        if not found:
            return
        start, end, period = np.array(found, np.int64).T
        free = ~self._inside(start, end)
        for kept, values in ((self.starts, start), (self.ends, end), (self.periods, period)):
            kept.append(values[free])


def _unit(texts: list[bytes | None], params: Periodic) -> list[tuple[list[bytes], np.ndarray]]:
    """Words and runs (rows of start, length, period) of each text."""
    words = [(t or b"").split() for t in texts]  # bytes.split() cuts at x20 and x09-x0D only
    number = defaultdict()
    number.default_factory = number.__len__
    order = sorted(range(len(texts)), key=lambda i: -len(words[i]))
    lengths = np.array([len(words[i]) for i in order], np.int64)
    total = int(lengths.sum()) + len(order)
    ids, at, begins = np.empty(total, np.int64), 0, np.empty(len(order), np.int64)
    for k, i in enumerate(order):
        n = len(words[i])
        begins[k] = at
        ids[at:at + n] = np.fromiter(map(number.__getitem__, words[i]), np.int64, n)
        ids[at + n] = -2 - k
        at += n + 1
    start, end, period = Catchers(params).runs(ids, lengths)
    text = np.searchsorted(begins, start, side="right") - 1
    cut = np.searchsorted(text, np.arange(len(order) + 1))
    rows = np.column_stack([start - begins[text], end - start, period]) if len(start) else np.zeros((0, 3), np.int64)
    out: list = [None] * len(texts)
    for k, i in enumerate(order):
        out[i] = (words[i], rows[cut[k]:cut[k + 1]])
    return out


def _kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    if not len(runs):
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def _detect(params: Periodic, collapse: bool):
    def run(batches):
        release()
        for batch in slices(batches, "text", params.unit_bytes):
            found = _unit(as_bytes(batch.column(1)), params)
            columns = [batch.column(0), pa.array([runs.tolist() for _, runs in found], pa.list_(pa.list_(pa.int64())))]
            names = ["id", "runs"]
            if collapse:
                columns.append(pa.array([b" ".join(_kept_words(w, r)) for w, r in found], pa.large_binary()).cast(pa.large_string()))
                names.append("collapsed")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Periodic = Periodic(),
                  collapse: bool = True) -> DataFrame:
    """``id_col, runs`` and, with ``collapse``, ``collapsed``: one row for each row of ``docs``.

    ``runs`` holds ``[start, length, period]`` (word numbers from 0) by start, then period;
    ``collapsed`` the words outside every run's repeats (a run keeps its first period), joined
    by one space. Texts are independent: no shuffle, whole texts, and the work of a text grows
    with n log n. Null and empty texts have no runs and an empty collapsed text; ids may be
    null or repeat (each row is its own text); other columns are ignored; an empty table
    gives no rows. A text longer than a work unit stands alone in one.
    """
    tune(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    more = ", collapsed string" if collapse else ""
    out = src.mapInArrow(_detect(params, collapse), f"id {kind}, runs array<array<bigint>>{more}")
    return out.withColumnRenamed("id", id_col)
