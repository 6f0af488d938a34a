"""Benchmark decontamination with a broadcast set of benchmark word windows.

The driver-side benchmark is checked by size before anything is broadcast: its items are cut
into slices of at most `max_words` words, and each slice is scanned for in a pass of its own,
so a benchmark of any size works and no broadcast grows with it. A pass hashes every window
of every whole text, looks the hashes up in the slice's sorted array, and verifies each hit
word by word before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlake.llm.text import U64, WordHashes, as_bytes, release, rolled, slices, tune
from barlake.session import written

# Bytes of words: digits, letters (A-Z lower-cased) and everything beyond ASCII; the rest cuts.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
                   for b in range(256))


@dataclass(frozen=True)
class Decontamination:
    window: int = 10
    max_words: int = 4_000_000   # words of benchmark text in one broadcast slice (about 100 MB)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class WindowSet:
    """Windows of one benchmark slice: for each width, sorted hashes with their texts and items."""

    def __init__(self, items: list[tuple], p: Decontamination):
        """items: (item id, text bytes); an item of fewer words than a window is one window."""
        hashes = WordHashes()
        seen: dict[tuple[int, int], dict[tuple, set]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            width = min(p.window, len(words))
            for i, h in enumerate(rolled(hashes.of(words), width).tolist()):
                seen.setdefault((width, h), {}).setdefault(tuple(words[i:i + width]), set()).add(item)
        self.by_width = {}
        for width in sorted({w for w, _ in seen}):
            keys = np.array(sorted(h for w, h in seen if w == width), U64)
            self.by_width[width] = keys, [{k: sorted(v) for k, v in seen[width, int(h)].items()} for h in keys]

    def hits(self, words: list[bytes], hashes: np.ndarray) -> list[tuple[int, int, list]]:
        """(start, end, items) of every verified window occurrence, ends in words."""
        out = []
        for width, (keys, texts) in self.by_width.items():
            if len(words) < width:
                continue
            found = rolled(hashes, width)
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            for i in np.flatnonzero(keys[at] == found):
                items = texts[at[i]].get(tuple(words[i:i + width]))
                if items is not None:
                    out.append((int(i), int(i) + width, items))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _scanning(shared):
    def run(batches):
        release()
        windows, hashes = shared.value, WordHashes(limit=200_000)
        for batch in slices(batches, "text"):
            n, spans, items = [], [], []
            for text, old_spans, old_items in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist(),
                                                  batch.column("items").to_pylist()):
                words = words_of(text)
                hits = windows.hits(words, hashes.of(words)) if words else []
                n.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in merged([(a, b) for a, b, _ in hits] + [(s["a"], s["b"]) for s in old_spans])])
                items.append(list({*old_items, *(i for _, _, found in hits for i in found)}))
            span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            cols = {"n_words": pa.array(n, pa.int64()), "spans": pa.array(spans, span),
                    "items": pa.array(items, batch.schema.field("items").type)}
            yield pa.RecordBatch.from_arrays([cols.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], names=batch.schema.names)
    return run


def _sliced(benchmark: DataFrame, item_col: str, text_col: str, p: Decontamination) -> Iterator[tuple[list[tuple], bool]]:
    """The benchmark's items slice by slice, each collected only when asked for, and whether it is the last."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = items.select(F.sum(F.length("text")).alias("n"), F.count("*").alias("rows")).first()
    chars = 6 * p.max_words  # a word has one character at least; a window set costs about as much for longer words
    if (size["n"] or 0) <= chars:
        yield [(r["item"], r["text"].encode()) for r in items.collect()], True
        return
    slices_ = -(-size["n"] // chars) * 2
    for i in range(slices_):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices_)) == i)
        yield [(r["item"], r["text"].encode()) for r in part.collect()], i + 1 == slices_


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         benchmark_text_col: str = "text", params: Decontamination = Decontamination()) -> DataFrame:
    """Hit word spans of every document.

    Returns ``row`` (a struct of the other columns of ``docs``), ``text, n_words, spans
    array<struct<a,b>>`` (words, end exclusive, merged), ``items``, a row for each input row. No shuffle. Defined cases: a null or empty
    text has no words; benchmark items that are null or have no words match nothing; equal
    windows of several items name all of them; a null item id is carried as null; other columns
    are carried whatever their names; empty tables give no rows or no hits.
    """
    p, spark = params, docs.sparkSession
    tune(spark)
    item_type = benchmark.schema[item_col].dataType.simpleString()
    others = [c for c in docs.columns if c != text_col]
    src = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"), F.lit(0).cast("bigint").alias("n_words"),
                      F.expr("cast(array() as array<struct<a: int, b: int>>)").alias("spans"),
                      F.expr(f"cast(array() as array<{item_type}>)").alias("items"))
    schema = src.schema
    for part, last in _sliced(benchmark, item_col, benchmark_text_col, p):
        shared = spark.sparkContext.broadcast(WindowSet(part, p))
        del part
        src = src.mapInArrow(_scanning(shared), schema)
        if not last:
            src = written(src, "decontaminate")  # one window set in memory at a time
            shared.destroy()
    return src


def _removing(batches):
    release()
    for batch in batches:
        out = []
        for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist()):
            out.append(_without(text, [(s["a"], s["b"]) for s in spans]).decode() if text and spans else None if text is None else text.decode())
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, "text", pa.array(out, pa.string()))


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    plain = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[False], plain, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last:starts[a]])
        last = ends[b - 1]
    return b"".join(kept) + text[last:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", drop_share: float = 0.5,
                  params: Decontamination = Decontamination()) -> DataFrame:
    """Documents without benchmark passages: hit spans are cut out of the text, and a document
    of which more than ``drop_share`` of the words are hit is dropped whole.

    Returns the columns of ``docs``; cases as for :func:`scan`. Texts without hits stay as they are.
    """
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)")
    found = scan(docs, benchmark, text_col, params=params).where(hit <= F.col("n_words") * drop_share).select("row", "text", "spans")
    found = written(found, "decontaminate-scan")  # two passes one after another: half the Python workers at a time
    out = found.mapInArrow(_removing, found.schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns])
