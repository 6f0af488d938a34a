"""Harmonic packing of tokenised documents into fixed-length sequences.

A piece of length l belongs to class k = capacity // l: k such pieces fill one sequence, so
a bin of class k is closed by counting, never by searching. Documents are cut so that every
piece nearly fills its share: whole sequences first, then the longest reciprocal of the
capacity that the rest reaches, until what is left wastes at most `slack` tokens a sequence.

Between the rounds a piece's ids are one binary value (little-endian 32-bit numbers).

Workers fill bins on their own in one pass over the texts. A worker's open bins (fewer than
k pieces in each class) are handed on, `fan_in` workers to one, until one task holds a few
pieces of each class; those last ones are packed first-fit. Nothing but these open bins ever
moves, whatever the amount of text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from barlake.llm.pretokens import read_vocabulary, unit_cuts
from barlake.llm.text import held, offsets_of, slices, tune
from barlake.session import written


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    end_id: int = 1
    slack: int = 32          # tokens of a sequence that may stay empty by a class's rounding
    fan_in: int = 64         # workers whose open bins one worker of the next round takes


def cut(n: int, p: Packing) -> list[int]:
    """Lengths of the pieces of a document of n >= 1 tokens."""
    whole, rest = divmod(n, p.capacity)
    out = [p.capacity] * whole
    while rest:
        k = p.capacity // rest
        if p.capacity - k * rest <= max(p.slack, rest if rest < p.slack else 0):
            out.append(rest)
            break
        out.append(p.capacity // (k + 1))
        rest -= out[-1]
    return out


class UnitIds(dict):
    """unit -> row of a ragged table of token ids; unknown units are encoded together. Beyond `limit`
    units, those that came again after they were learnt stay, unless they are half the limit themselves."""

    def __init__(self, vocabulary: str, limit: int = 500_000):
        super().__init__()
        read_vocabulary(vocabulary)  # refuses a vocabulary whose tokens depend on more than a unit
        self.lib = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.limit = limit
        self.unknown: list[str] = []
        self._begin()

    def _begin(self):
        self.clear()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)

    def _forget(self):
        kept = np.flatnonzero(self.again[:len(self)])
        if len(kept) > self.limit // 2:
            return self._begin()
        units, size = list(self), self.size[kept]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[kept] - ends + size, size) + np.arange(int(size.sum()))]
        self._begin()
        self.update((units[row], i) for i, row in enumerate(kept.tolist()))
        self._append(flat, size)

    def __missing__(self, unit: str) -> int:
        row = self[unit] = len(self)
        self.unknown.append(unit)
        return row

    def _learn(self):
        self._append(*self._encoded(self.unknown))
        self.unknown = []

    def _append(self, flat: np.ndarray, size: np.ndarray):
        """The ids of the last len(size) units."""
        first, total = len(self) - len(size), len(flat)
        while len(self) > len(self.start):
            n = 2 * len(self.start)
            self.start, self.size, self.again = (np.resize(x, n) for x in (self.start, self.size, self.again))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.size[first:len(self)] = size
        self.start[first:len(self)] = self.used + np.cumsum(size) - size
        self.again[first:len(self)] = False
        self.flat[self.used:self.used + total] = flat
        self.used += total

    def _encoded(self, units: list[str], run: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, one after another, and the number of each unit's.

        The library treats what stands between special strings as texts of their own, so units
        joined by one are encoded in runs, which spares an object for each.
        """
        if not self.special:
            ids = [e.ids for e in self.lib.encode_batch_fast(units, add_special_tokens=False)]
            return np.array([x for one in ids for x in one], np.int32), np.fromiter(map(len, ids), np.int64, len(ids))
        mark = self.special[0]
        runs = [mark.join(units[i:i + run]) + mark for i in range(0, len(units), run)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.lib.encode_batch_fast(runs, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.lib.token_to_id(mark))
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def encode(self, texts: pa.Array | list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after another, each with ``end_id`` behind it, and where each
        ends: one gather for the whole batch. Each different unit of the batch is looked up once."""
        if len(self) > self.limit:
            self._forget()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd, known = {}, len(self)
        for s in self.special:  # a special string in the text is the library's own business
            there = pc.match_substring(column, s)
            for i in np.flatnonzero(there.to_numpy(zero_copy_only=False)).tolist():
                odd[i] = np.array(self.lib.encode(column[i].as_py(), add_special_tokens=False).ids, np.int32)
            if odd:
                column = pc.if_else(there, pa.scalar("", column.type), column)
        starts = offsets_of(column)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[starts[0]:starts[-1]]
        starts -= starts[0]
        cuts = unit_cuts(data, starts)
        units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        rows = np.fromiter(map(self.__getitem__, units.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(units.dictionary))
        if self.unknown:
            self._learn()
        self.again[rows[rows < known]] = True
        row = rows[units.indices.to_numpy()]
        size = self.size[row]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[row] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.searchsorted(cuts, starts[1:])]  # ids up to each text, odd ones left out
        flat = np.insert(flat, upto, np.int32(end_id))
        stops = upto + np.arange(1, len(texts) + 1)
        if odd:
            parts = np.split(flat, stops[:-1])
            parts = [np.concatenate([odd[i], part]) if i in odd else part for i, part in enumerate(parts)]
            flat, stops = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return flat, stops


class Bins:
    """Open bins, one for each class; a bin of class k leaves when it holds k pieces.

    A piece is (document, start, bytes of its ids, tokens of the document)."""

    def __init__(self, worker: int, p: Packing):
        self.worker, self.p = worker, p
        self.open: dict[int, list] = {}
        self.made: dict[int, int] = {}
        self.rows: list = []

    def add(self, piece: tuple) -> None:
        k = self.p.capacity // (len(piece[2]) >> 2)
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            self.close(k, self.open.pop(k))

    def close(self, k: int, pieces: list) -> None:
        """sequence id: 24 bits of worker, 11 of class, 28 of running number."""
        n = self.made.get(k, 0)
        self.made[k] = n + 1
        sequence, offset = self.worker << 39 | (k - 1) << 28 | n, 0
        for one in pieces:
            self.rows.append((*one, sequence, offset))
            offset += len(one[2]) >> 2

    def finish(self) -> None:
        """First fit, longest first, over the few pieces that no class could complete."""
        rest = sorted((x for bin_ in self.open.values() for x in bin_), key=lambda x: -len(x[2]))
        self.worker |= 1 << 23
        self.open, self.made, room, filled = {}, {}, [], []
        for one in rest:
            size = len(one[2]) >> 2
            at = next((i for i, r in enumerate(room) if r >= size), None)
            if at is None:
                at = len(room)
                room.append(self.p.capacity)
                filled.append([])
            room[at] -= size
            filled[at].append(one)
        for pieces in filled:
            self.close(1, pieces)


def _batch(rows, id_type) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = (id_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=["id", "start", "ids", "doc_tokens", "sequence_id", "seq_offset"])


def _drained(bins: Bins, id_type):
    """The rows of bins closed so far."""
    if bins.rows:
        yield _batch(bins.rows, id_type)
        bins.rows = []


def _opened(bins: Bins, id_type):
    rows = [(*x, None, None) for bin_ in bins.open.values() for x in bin_]
    if rows:
        yield _batch(rows, id_type)


def _first_round(vocabulary: str, p: Packing):
    def run(batches):
        units = held(("packing", vocabulary), lambda: UnitIds(vocabulary))
        bins, id_type = Bins(TaskContext.get().partitionId(), p), pa.int64()
        for batch in slices(batches, "text", 2 << 20):
            id_type = batch.column(0).type
            flat, stops = units.encode(batch.column(1), p.end_id)
            data, begin = memoryview(flat.astype("<i4", copy=False)).cast("B"), 0
            for doc, stop in zip(batch.column(0).to_pylist(), stops.tolist()):
                total, start = stop - begin, 0
                for n in cut(total, p):
                    at = 4 * (begin + start)
                    bins.add((doc, start, bytes(data[at:at + 4 * n]), total))
                    start += n
                begin = stop
            yield from _drained(bins, id_type)
        yield from _drained(bins, id_type)
        yield from _opened(bins, id_type)
    return run


def _next_round(number: int, last: bool, p: Packing):
    def run(batches):
        bins, id_type = Bins(number << 20 | TaskContext.get().partitionId(), p), pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for piece in zip(*(batch.column(c).to_pylist() for c in range(4))):
                bins.add(piece)
            yield from _drained(bins, id_type)
        if last:
            bins.finish()
        yield from _drained(bins, id_type)
        yield from _opened(bins, id_type)
    return run


def packed(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           params: Packing = Packing()) -> DataFrame:
    """As :func:`pack`, with the ids of a piece as one binary value (``ids``)."""
    p, spark = params, docs.sparkSession
    if p.capacity > 2048:
        raise ValueError("a sequence id has 11 bits for the class")
    tune(spark)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, seq_offset bigint"
    workers = max(1, src.rdd.getNumPartitions())
    if workers >= 1 << 20:
        raise ValueError("a sequence id has 20 bits for the partition: coalesce the documents to fewer than 1,048,576 partitions")
    rounds = [written(src.mapInArrow(_first_round(vocabulary, p), schema), "packing")]
    while True:
        workers = -(-workers // p.fan_in)
        left = rounds[-1].where("sequence_id is null")
        dealt = left.coalesce(1) if workers == 1 else left.repartition(workers)
        rounds.append(written(dealt.mapInArrow(_next_round(len(rounds), workers == 1, p), schema), "packing"))
        if workers == 1:
            break
    out = rounds[0].where("sequence_id is not null")
    for r in rounds[1:]:
        out = out.unionByName(r.where("sequence_id is not null"))
    return out.withColumnRenamed("id", id_col)


def _listed(batches):
    for batch in batches:
        column = batch.column("ids")
        ends = pa.array((offsets_of(column) // 4).astype(np.int32))
        values = np.frombuffer(column.buffers()[2] or b"", "<i4")
        lists = pa.ListArray.from_arrays(ends, pa.array(values))
        cols = [lists if n == "ids" else batch.column(n) for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays(cols, names=["input_ids" if n == "ids" else n for n in batch.schema.names])


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
         params: Packing = Packing()) -> DataFrame:
    """Pieces of all documents, with their place in the packed sequences.

    Returns ``id_col, start, input_ids, doc_tokens, sequence_id, seq_offset``, a row for each
    piece: ids of the library for ``vocabulary`` (a path that every worker can read) and then
    ``end_id``. Defined cases: a null or empty text is the end id alone; null and repeated
    ids are documents of their own; a text of any length is cut; other columns are ignored;
    an empty table gives no pieces; a million input partitions or more are refused.
    """
    out = packed(docs, vocabulary, id_col, text_col, params)
    kind = out.schema[id_col].dataType.simpleString()
    return out.mapInArrow(_listed, f"`{id_col}` {kind}, start bigint, input_ids array<int>, doc_tokens bigint, sequence_id bigint, seq_offset bigint")
