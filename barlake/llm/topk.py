"""Exact top-k search over integer vectors, by distributed histogram selection.

Every candidate is scored against every query, block against block, but scores are never
stored. A first round of scoring counts, for each query, how many scores fall into each of
`bins` equal parts of its possible range; the summed histogram shows the part that holds the
k-th highest score. Further rounds cut that part alone into finer parts, until it is one
value wide or so few scores reach it that they can be told apart by sorting. A last round
keeps the scores that reach the part, and of those equal to an exact k-th value only as many
smallest ids as can still be wanted. Rank and ties are settled by one sort for each query.

Queries are taken in slices whose bytes are bounded (`slice_bytes`); a slice is what is
broadcast, and every round of it reads all candidates. A task holds one slice, one block of
candidates and one histogram of the slice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barlake.llm.text import held, tune
from barlake.session import written

EXACT = float(1 << 53)   # integers below it are exact in float64
MOST = (1 << 62) - 1     # scores stay within it, so that their differences fit 64 bits


@dataclass(frozen=True)
class TopK:
    k: int = 20
    scale: float = 64.0            # component -> floor(scale * component)
    bins: int = 64                 # parts of a range in one round
    sortable: int = 4              # stop once at most sortable * k scores reach the part
    slice_bytes: int = 16 << 20    # of query vectors broadcast at once (8 bytes a component)
    block_rows: int = 1024         # candidates, and queries, scored at once

    def __post_init__(self):
        if self.k < 1 or self.bins < 2 or self.sortable < 1:
            raise ValueError("k and sortable must be at least 1, bins at least 2")


def usable(vector: Column) -> Column:
    """Rows that take part: a vector without null or non-finite components."""
    v = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(column: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (row numbers, float64 matrix of the scaled floors) of a batch of vectors."""
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale), -1e300, 1e300)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    begins = np.cumsum(lengths) - lengths
    out = {}
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        out[d] = rows, flat[begins[rows][:, None] + np.arange(d)]
    return out


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64; beyond MOST they stay at the ends of the range."""
    with np.errstate(over="ignore"):
        most = np.abs(queries).sum(axis=1).max(initial=0.0) * np.abs(candidates).max(initial=0.0)
    if most < EXACT:
        return (queries @ candidates.T).astype(np.int64)
    if most < MOST / 2:
        return queries.astype(np.int64) @ candidates.astype(np.int64).T
    exact = [[int(x) for x in row] for row in candidates.tolist()]
    return np.array([[max(-MOST, min(MOST, sum(a * b for a, b in zip(q, c)))) for c in exact]
                     for q in ([int(x) for x in row] for row in queries.tolist())], np.int64).reshape(len(queries), len(candidates))


class Slice:
    """Queries of one slice by dimension: row numbers, ids, matrix, and each one's part of the scores.

    A query's part is `low` to `low + (bins << shift) - 1`; `shift` < 0 means settled: scores from
    `low` on are kept, all of them where `ties` < 0, else of those equal to `low` only the `ties`
    smallest ids.
    """

    def __init__(self, table: pa.Table, params: TopK):
        self.params, self.groups = params, {}
        row, vec_id = (table.column(c).to_numpy() for c in ("row", "id"))
        for d, (at, matrix) in integers(table.column("vec").combine_chunks(), params.scale).items():
            self.groups[d] = {"row": row[at], "id": vec_id[at], "matrix": matrix}

    def begin(self, largest: float) -> None:
        """The whole range of scores, from the largest component of any candidate."""
        for g in self.groups.values():
            with np.errstate(over="ignore"):
                reach = np.minimum(np.abs(g["matrix"]).sum(axis=1) * largest * (1 + 1e-9) + 1, float(MOST))
            g["low"] = -reach.astype(np.int64)
            width = 2 * reach + 1
            g["shift"] = np.maximum(0, np.ceil(np.log2(width / self.params.bins))).astype(np.int64)
            g["ties"] = np.full(len(reach), -1, np.int64)

    def narrow(self, found: dict[int, tuple[int, int, int]]) -> None:
        """found: row -> (bin that holds the k-th score, scores above it, scores in it)."""
        p = self.params
        for g in self.groups.values():
            for i, row in enumerate(g["row"].tolist()):
                if g["shift"][i] < 0:
                    continue
                if row not in found:  # fewer than k candidates: all are kept
                    g["low"][i], g["shift"][i] = -MOST, -1
                    continue
                bin_, above, inside = found[row]
                width = int(g["shift"][i])
                g["low"][i] += bin_ << width
                if above + inside <= p.sortable * p.k:
                    g["shift"][i] = -1
                elif width == 0:
                    g["shift"][i], g["ties"][i] = -1, p.k - above
                else:
                    g["shift"][i] = max(0, width - (p.bins.bit_length() - 1))

    def open(self) -> bool:
        return any((g["shift"] >= 0).any() for g in self.groups.values())

    def counted(self, d: int, ids: np.ndarray, matrix: np.ndarray, counts: dict[int, np.ndarray]) -> None:
        """Adds a block's scores to the histograms of the open queries; one bin more holds what lies above the part."""
        g, bins = self.groups[d], self.params.bins
        open_ = np.flatnonzero(g["shift"] >= 0)
        if d not in counts:
            counts[d] = np.zeros((len(open_), bins + 2), np.int64)
        for start in range(0, len(open_), self.params.block_rows):
            at = open_[start:start + self.params.block_rows]
            offset = products(g["matrix"][at], matrix) - g["low"][at, None]
            part = np.minimum(offset >> g["shift"][at, None], bins)
            part[(offset < 0) | (ids[None, :] == g["id"][at, None])] = bins + 1
            part += np.arange(len(at))[:, None] * (bins + 2)
            counts[d][start:start + len(at)] += np.bincount(part.ravel(), minlength=len(at) * (bins + 2)).reshape(len(at), bins + 2)

    def histograms(self, counts: dict[int, np.ndarray]) -> pa.RecordBatch:
        """Non-empty bins, without those below a bin at which this task alone has k scores:
        the k-th score of all candidates cannot lie there."""
        rows, bins, ns = [], [], []
        for d, sums in counts.items():
            g = self.groups[d]
            row = g["row"][np.flatnonzero(g["shift"] >= 0)]
            sums = sums[:, :-1]
            above = sums[:, ::-1].cumsum(axis=1)[:, ::-1] - sums
            i, b = np.nonzero((sums > 0) & (above < self.params.k))
            rows.append(row[i])
            bins.append(b)
            ns.append(sums[i, b])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cat(rows).astype(np.int64)), pa.array(cat(bins).astype(np.int32)),
                                           pa.array(cat(ns).astype(np.int64))], names=["row", "bin", "n"])

    def reaching(self, d: int, ids: np.ndarray, matrix: np.ndarray):
        """The block's scores that reach the parts of their queries."""
        g = self.groups[d]
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], matrix[order]
        for start in range(0, len(g["row"]), self.params.block_rows):
            at = slice(start, start + self.params.block_rows)
            scores, low, ties = products(g["matrix"][at], matrix), g["low"][at, None], g["ties"][at]
            good = (scores >= low) & (ids[None, :] != g["id"][at, None])
            tied = np.flatnonzero(ties >= 0)
            if len(tied):  # of a block's scores equal to the k-th, no more than are wanted of all
                equal = good[tied] & (scores[tied] == low[tied])
                good[tied] &= ~(equal & (np.cumsum(equal, axis=1) > ties[tied, None]))
            q, c = np.nonzero(good)
            yield pa.RecordBatch.from_arrays([pa.array(g["row"][at][q]), pa.array(g["id"][at][q]), pa.array(ids[c]), pa.array(scores[q, c])],
                                             names=["row", "query_id", "vec_id", "score"])


def _blocks(batches, params: TopK, dims):
    """(dimension, ids, matrix) of the candidates, dimensions without queries left out."""
    for batch in batches:
        for start in range(0, batch.num_rows, params.block_rows):
            part = batch.slice(start, params.block_rows)
            ids = part.column(0).to_numpy()
            for d, (rows, matrix) in integers(part.column(1), params.scale).items():
                if d in dims:
                    yield d, ids[rows], matrix


def _scan(shared, params: TopK, last: bool):
    key = shared._jbroadcast.id()

    def run(batches):
        queries: Slice = held(("top-k", key), lambda: shared.value)
        counts: dict[int, np.ndarray] = {}
        for d, ids, matrix in _blocks(batches, params, queries.groups):
            if last:
                yield from queries.reaching(d, ids, matrix)
            else:
                queries.counted(d, ids, matrix, counts)
        if not last:
            yield queries.histograms(counts)
    return run


def _kth(histogram: DataFrame, k: int) -> dict[int, tuple[int, int, int]]:
    """row -> (bin of the k-th score, scores above it, scores in it); at most one row for each query of a slice."""
    sums = histogram.groupBy("row", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("row").orderBy(F.col("bin").desc())
    reached = sums.withColumn("upto", F.sum("n").over(down)).where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k))
    return {r: (b, upto - n, n) for r, b, n, upto in reached.select("row", "bin", "n", "upto").collect()}


def _ranges(queries: DataFrame, rows: int) -> list[tuple[int, int]]:
    """Ranges of row numbers with at most `rows` queries each; numbers are consecutive in a partition."""
    size = F.shiftright("row", 33)
    parts = queries.groupBy(size.alias("part")).agg(F.min("row").alias("low"), F.max("row").alias("high")).orderBy("part").collect()
    out: list[list[int]] = []
    room = 0
    for _, low, high in parts:
        while low <= high:
            take = min(high - low + 1, room or rows)
            if room:
                out[-1][1] = low + take - 1
            else:
                out.append([low, low + take - 1])
            room = (room or rows) - take
            low += take
    return [(a, b) for a, b in out]


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
          params: TopK = TopK()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each query, ranks from 1.

    Vectors are compared as ``floor(scale * component)`` in exact integers (a product beyond 62
    bits counts as the end of that range). Queries are the rows that satisfy ``is_query``;
    candidates are all rows whose id differs from the query's. Equal scores go by smaller id.
    A query with fewer than k candidates returns them all. Rows with a null id, a null vector, or
    null or non-finite components take no part; vectors of different lengths are not compared;
    a repeated row is a candidate, and a query, as often as it occurs. An empty table, or one
    without queries, gives no rows; other columns are ignored.

    Runs jobs when called: about three rounds of scoring for each slice of queries, whose rows
    are written to the shared folder.
    """
    spark = vectors.sparkSession
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(params.block_rows))
    rows = vectors.where(is_query.isNotNull() & F.col(id_col).isNotNull() & usable(F.col(vec_col)))
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("query"))
    candidates = rows.select("id", "vec")
    queries = written(rows.where("query").select(F.monotonically_increasing_id().alias("row"), "id", "vec"), "topk-queries")
    dims = queries.agg(F.max(F.size("vec"))).collect()[0][0]
    parts = []
    if dims is not None:
        largest = candidates.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).collect()[0][0]
        size = 8 * max(dims, params.bins + 2)  # of a query's vector, and of its histogram in a task
        for low, high in _ranges(queries, max(1, params.slice_bytes // size)):
            parts.append(_sliced(spark, queries.where(F.col("row").between(low, high)), candidates, largest * params.scale + 1, params))
    schema = "row bigint, query_id bigint, vec_id bigint, score bigint"
    found = spark.createDataFrame([], schema) if not parts else parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= params.k)
            .select("query_id", "rank", "vec_id", "score"))


def _sliced(spark: SparkSession, queries: DataFrame, candidates: DataFrame, largest: float, params: TopK) -> DataFrame:
    work = Slice(queries.toArrow(), params)
    work.begin(largest)
    while work.open():
        shared = spark.sparkContext.broadcast(work)
        work.narrow(_kth(candidates.mapInArrow(_scan(shared, params, False), "row bigint, bin int, n bigint"), params.k))
        shared.unpersist()
    shared = spark.sparkContext.broadcast(work)
    found = candidates.mapInArrow(_scan(shared, params, True), "row bigint, query_id bigint, vec_id bigint, score bigint")
    return written(found, "topk")
