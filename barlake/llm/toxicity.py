"""Toxicity by a small convolutional network over hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of its hash and of the hashes of its first and
last letters (inflected and compounded forms share them). Filters of several widths run over
all words of a text, the maximum of each filter over the whole text goes through a logistic
output. Only hashes met in several training texts have an embedding; others are zero, so rare
words say nothing.

Training reads a bounded sample of labelled rows (`sample` rows, half of each label where there
are as many, none longer than `train_chars` characters); scoring reads every word of every text, in blocks
of bounded size. Thresholds are calibrated by language on labelled rows that training leaves
aside, from histograms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barlake.llm.text import give_back, held, release, slices, tune
from barlake.session import written

EDGE = ".,;:!?\"'()[]{}<>*#-_|"


@dataclass(frozen=True)
class ToxicNet:
    dim: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 16            # of each width
    sample: int = 6000           # labelled rows that training may take
    train_chars: int = 40_000    # longer texts are not taken into the sample (they are scored whole)
    least_texts: int = 3         # training texts that must hold a hash for it to get an embedding
    affix: int = 4
    steps: int = 1500
    batch: int = 32
    rate: float = 0.05
    seed: int = 11
    grid: int = 64               # cells of the calibration histograms
    least_labels: int = 20       # calibration rows of either label below which 0.5 stays


def word_hashes(word: str, affix: int) -> tuple[int, int, int]:
    """Hashes of a word (edge marks stripped), its beginning and its end; 0 for none."""
    w = word.strip(EDGE)
    if not w:
        return 0, 0, 0
    return tuple(xxhash.xxh32_intdigest(kind + part) or 1
                 for kind, part in (("w", w), ("b", w[:affix]), ("e", w[-affix:])))


class Words(dict):
    """raw word -> row of a growing matrix; begun anew beyond `limit` words."""

    def __init__(self, affix: int, limit: int = 200_000):
        super().__init__()
        self.affix, self.limit, self.fresh = affix, limit, []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.fresh.append(word_hashes(word, self.affix))
        return row

    def rows(self, text: str) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Net:
    """Weights; ids are the hashes with an embedding, row 0 of emb is the zero vector."""

    def __init__(self, ids: np.ndarray, p: ToxicNet):
        rng = np.random.default_rng(p.seed)
        self.p, self.ids = p, np.sort(ids.astype(np.int64))
        self.emb = rng.normal(0, 0.05, (len(ids) + 1, p.dim)).astype(np.float32)
        self.emb[0] = 0
        self.conv = [rng.normal(0, 1 / np.sqrt(w * p.dim), (w, p.dim, p.filters)).astype(np.float32) for w in p.widths]
        n = len(p.widths) * p.filters
        self.bias = np.zeros(n, np.float32)
        self.out = (np.abs(rng.normal(0, 1, n)) * np.where(np.arange(n) % 4 == 3, -1, 1)).astype(np.float32)
        self.prior = np.float32(0)

    def emb_rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.ids, hashes), len(self.ids) - 1)
        return np.where(self.ids[at] == hashes, at + 1, 0)

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(words, filters of all widths) of the windows beginning at each word; x is padded by
        max(widths) - 1 zero rows."""
        n = len(x) - max(self.p.widths) + 1
        parts = []
        for kernel in self.conv:
            y = x[:n] @ kernel[0]
            for j in range(1, len(kernel)):
                y += x[j:j + n] @ kernel[j]
            parts.append(y)
        return np.concatenate(parts, axis=1) + self.bias

    def pooled(self, vectors: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, block: int = 32_768):
        """Maxima (texts, filters), at least 0. Texts stand one after another in `rows`, each
        followed by max(widths) - 1 pads (row of zeros); blocks bound the memory."""
        pad = max(self.p.widths) - 1
        out = np.zeros((len(starts), len(self.bias)), np.float32)
        for a in range(0, len(rows), block):
            part = vectors[rows[a:a + block + pad]]
            if len(part) < block + pad:
                part = np.concatenate([part, np.zeros((pad, part.shape[1]), np.float32)])
            y = self.responses(part)[:min(block, len(rows) - a)]
            b = a + len(y)
            first = np.searchsorted(starts + sizes, a, side="right")
            last = np.searchsorted(starts, b, side="left")
            for i in range(first, last):
                s, e = max(starts[i], a) - a, min(starts[i] + sizes[i], b) - a
                if e > s:
                    np.maximum(out[i], y[s:e].max(axis=0), out=out[i])
        return out

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        """Rounded to 5 digits: single-precision sums differ in the last ones with the block they fall in."""
        return np.round(1 / (1 + np.exp(-(pooled @ self.out + self.prior).astype(np.float64))), 5)


def train(texts: list[np.ndarray], labels: np.ndarray, p: ToxicNet) -> Net:
    """texts: for each training text the (words, 3) hashes of its words."""
    ids, texts_with = np.unique(np.concatenate([np.zeros(0, np.uint32), *map(np.unique, texts)]), return_counts=True)
    net = Net(ids[(texts_with >= p.least_texts) & (ids != 0)], p)
    if not len(texts) or len(set(labels.tolist())) < 2:
        net.prior = np.float32(-4 if not labels.sum() else 4)
        return net
    rng, pad = np.random.default_rng(p.seed + 1), max(p.widths) - 1
    rows = [np.concatenate([net.emb_rows(t), np.zeros((pad, 3), np.int64)]).astype(np.int32) for t in texts]
    width_of = np.repeat(np.arange(len(p.widths)), p.filters)
    slots = [np.zeros_like(w) for w in (net.emb, *net.conv, net.bias, net.out)]
    prior_slot = 0.0
    classes = [np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)]

    def step(w, slot, g, at=slice(None)):
        slot[at] += g * g
        w[at] -= p.rate * g / (np.sqrt(slot[at]) + 1e-6)

    for _ in range(p.steps):
        chosen = np.concatenate([rng.choice(c, p.batch // 2) for c in classes])
        flat = np.concatenate([rows[i] for i in chosen] + [np.zeros((pad, 3), np.int32)])
        x = net.emb[flat[:, 0]] + net.emb[flat[:, 1]] + net.emb[flat[:, 2]]
        y = net.responses(x)
        ends = np.cumsum([len(rows[i]) for i in chosen])
        best = np.zeros((len(chosen), y.shape[1]), np.int64)
        top = np.zeros((len(chosen), y.shape[1]), np.float32)
        for d, (end, i) in enumerate(zip(ends, chosen)):
            start, stop = end - len(rows[i]), end - pad
            if stop > start:
                best[d] = y[start:stop].argmax(axis=0) + start
                top[d] = np.maximum(y[best[d], np.arange(y.shape[1])], 0)
        off = 1 / (1 + np.exp(-(top @ net.out + net.prior))) - labels[chosen]
        g_out, g_prior = off @ top, float(off.sum())
        g_top = (off[:, None] * net.out * (top > 0)).astype(np.float32)
        g_bias = g_top.sum(axis=0)
        g_conv = [np.zeros_like(k) for k in net.conv]
        touched, grads = [], []
        doc, f = np.nonzero(g_top)
        g, at, col = g_top[doc, f][:, None], best[doc, f], f % p.filters
        for w, kernel in enumerate(net.conv):
            own = width_of[f] == w
            for j in range(len(kernel)):
                np.add.at(g_conv[w][j].T, col[own], g[own] * x[at[own] + j])
                back = g[own] * kernel[j][:, col[own]].T
                for one in range(3):
                    touched.append(flat[at[own] + j, one])
                    grads.append(back)
        n = len(chosen)
        if len(doc):
            one, back = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(one), p.dim), np.float32)
            np.add.at(total, back, np.concatenate(grads))
            total[one == 0] = 0
            step(net.emb, slots[0], total / n, one)
        for k, s, change in zip(net.conv, slots[1:], g_conv):
            step(k, s, change / n)
        step(net.bias, slots[-2], g_bias / n)
        step(net.out, slots[-1], (g_out / n).astype(np.float32))
        prior_slot += (g_prior / n) ** 2
        net.prior -= np.float32(p.rate * g_prior / n / (np.sqrt(prior_slot) + 1e-6))
    return net


def _hashing(affix: int):
    def run(batches):
        release()
        words = Words(affix)
        for batch in slices(batches, "text"):
            rows = [words.rows(t or "") for t in batch.column("text").to_pylist()]
            table = np.array(words.fresh or [(0, 0, 0)], np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([table[r].tobytes() for r in rows], pa.binary())], names=["id", "label", "hashes"])
            words = Words(affix)
    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, p: ToxicNet) -> Net:
    """Network from at most `sample` labelled rows; `labels` holds the rows training may see."""
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    short = texts.select("id", F.length("text").alias("n")).where(F.col("n") <= p.train_chars)
    able = marks.join(short.select("id").distinct(), "id", "left_semi")
    half = [able.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(p.sample // 2) for c in (0, 1)]
    chosen = written(half[0].unionByName(half[1]), "toxic-sample")
    rows = texts.join(F.broadcast(chosen), "id").where(F.length("text") <= p.train_chars)
    # `sample` ids at most, of each the text of least hash: the same one in every run
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = (rows.select("id", "label", "text").mapInArrow(_hashing(p.affix), f"id {kind}, label int, hashes binary").toArrow())
    order = np.argsort(np.array([str(x) for x in found["id"].to_pylist()]), kind="stable").tolist()
    labelled = np.array(found["label"].to_pylist(), np.int64)[order]
    hashes = found["hashes"].to_pylist()
    del found
    net = train([np.frombuffer(hashes[i], np.uint32).reshape(-1, 3) for i in order], labelled, p)
    del hashes
    give_back()  # the driver lives on, and other operators with it
    return net


def _scoring(shared, key: int, p: ToxicNet):
    def run(batches):
        net = shared.value
        # rows of the known words; behind the last one a row of zeros, which pads the texts
        words, known = held(("toxicity", key), lambda: (Words(p.affix), [np.zeros((1 << 14, p.dim), np.float32), 0]))
        pad = max(p.widths) - 1
        for batch in slices(batches, "text", 1 << 20):
            if len(words) > words.limit:
                words.clear()
                known[1] = 0
            rows = [words.rows(t or "") for t in batch.column("text").to_pylist()]
            if words.fresh:
                at = net.emb_rows(np.array(words.fresh, np.int64))
                new = net.emb[at[:, 0]] + net.emb[at[:, 1]] + net.emb[at[:, 2]]
                n, known[1], words.fresh = known[1], known[1] + len(new), []
                if known[1] >= len(known[0]):
                    grown = np.zeros((max(known[1] + 1, 2 * len(known[0])), p.dim), np.float32)
                    grown[:n] = known[0][:n]
                    known[0] = grown
                known[0][n:known[1]] = new
            known[0][known[1]] = 0
            vectors = known[0][:known[1] + 1]
            sizes = np.array([len(r) for r in rows], np.int64)
            gap = np.full(pad, len(vectors) - 1, np.int64)
            flat = np.concatenate([x for r in rows for x in (r, gap)])
            starts = np.cumsum(sizes + pad) - sizes - pad
            score = net.scores(net.pooled(vectors, flat, starts, sizes))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], names=["id", "score"])
    return run


def score(docs: DataFrame, net: Net, id_col: str, text_col: str) -> DataFrame:
    """``id, score`` of every whole text; the network (a few MB, bounded by the sample) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_scoring(shared, shared._jbroadcast.id(), net.p), f"id {kind}, score double")


def thresholds(scored: DataFrame, p: ToxicNet) -> DataFrame:
    """``lang, score, label`` of calibration rows -> ``lang, threshold``: the cut of the grid with
    fewest errors, nearest to 0.5 among equals; languages with few labels are absent."""
    cells = (scored.select("lang", F.least(F.floor(F.col("score") * p.grid), F.lit(p.grid - 1)).cast("int").alias("s"), "label")
             .groupBy("lang", "s").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")))
    langs = cells.groupBy("lang").agg(F.sum("bad").alias("n_bad"), F.sum("good").alias("n_good"))
    langs = langs.where((F.col("n_bad") >= p.least_labels) & (F.col("n_good") >= p.least_labels))
    cuts = langs.select("lang", F.explode(F.sequence(F.lit(1), F.lit(p.grid - 1))).alias("c"))
    errors = (cuts.join(cells, "lang").groupBy("lang", "c")
              .agg(F.sum(F.when(F.col("s") >= F.col("c"), F.col("good")).otherwise(F.col("bad"))).alias("errors")))
    best = errors.groupBy("lang").agg(F.min(F.struct("errors", F.abs(F.col("c") * 2 - p.grid), "c")).alias("b"))
    return best.select("lang", (F.col("b.c") / p.grid).alias("threshold"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             lang_col: str = "lang", params: ToxicNet = ToxicNet()) -> DataFrame:
    """Score of every document, and whether it passes its language's threshold.

    Labelled ids whose crc32 mod 5 is 0 are held out of everything; those with remainder 1
    calibrate the thresholds; the others train. Returns ``id_col, held_out, score, predicted,
    threshold, rejected``, one row per input row. Scores see the words only. Defined cases: null
    and empty texts score as a text without words; a language that is null, or has too few
    labels, has threshold 0.5; ids that are null have no label and are not held out; repeated
    rows score alike; without labels of both kinds every score is near 0 (or 1); other columns
    are ignored; an empty table gives no rows.
    """
    p, spark = params, docs.sparkSession
    tune(spark)
    part = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
    seen = labels.select(id_col, label_col).where(F.col(label_col).isin(0, 1)).withColumn("_part", part)
    net = fit(docs, seen.where("_part > 1"), id_col, text_col, label_col, p)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    scored = written(score(named.select(F.struct("id", "lang").alias("id"), "text"), net, "id", "text"), "toxic-scores")
    scored = scored.select("id.id", "id.lang", "score")
    aside = seen.where("_part = 1").groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("long").alias("label"))
    cuts = thresholds(scored.join(aside, "id"), p)
    # a map of the languages that have labels enough: no row of a frequent language moves
    limits = cuts.where("lang is not null").agg(F.map_from_entries(F.collect_list(F.struct("lang", "threshold")))).scalar()
    out = scored.withColumn("limits", limits).withColumn("threshold", F.coalesce(F.expr("try_element_at(limits, lang)"), F.lit(0.5)))
    return out.select(F.col("id").alias(id_col), F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold",
                      (F.col("score") >= F.col("threshold")).alias("rejected"))
