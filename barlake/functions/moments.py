"""Pairwise-complete second moments of many columns in one pass.

Every partition reduces its Arrow batches to one row for each pair of columns (matrix products
over the valid values), and a plain aggregate adds those rows up: the same plan for three
columns or three hundred, with nulls or without. Values are shifted by the column's minimum,
so a constant column has variance 0 exactly and large offsets cost no digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _reduced(shift: np.ndarray):
    p = len(shift)
    i, j = np.triu_indices(p)

    def run(batches):
        total = np.zeros((len(NAMES), p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
            valid = ~np.isnan(x)
            x, v = np.where(valid, x, 0.0), valid.astype(float)
            total += [v.T @ v, x.T @ v, v.T @ x, (x * x).T @ v, v.T @ (x * x), x.T @ x]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t[i, j]) for t in total]],
                                         names=["i", "j", *NAMES])
    return run


def cross_moments(df: DataFrame, columns: list[str]) -> tuple[DataFrame, np.ndarray]:
    """``(i, j, n, sx, sy, sxx, syy, sxy)`` for i <= j over the rows where both are present,
    of values less the returned shifts."""
    data = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    low = data.agg(*[F.min(F.when(~F.isnan(c), F.col(c))).alias(c) for c in data.columns]).first()
    shift = np.array([0.0 if x is None or not np.isfinite(x) else x for x in low], float)
    parts = data.mapInArrow(_reduced(shift), "i int, j int, " + ", ".join(f"{n} double" for n in NAMES))
    return parts.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in NAMES]), shift


def group_moments(df: DataFrame, columns: list[str], by: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(rows, means, centred cross products) of ``columns`` for each value of the integer column ``by``.

    Rows have no nulls. A first pass gives the means, so the second adds up products of values
    that are centred already; a group is a row for each pair of columns on the driver."""
    p = len(columns)
    i, j = np.triu_indices(p)
    data = df.select(F.col(by).cast("int").alias("g"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    means = data.groupBy("g").agg(F.count(F.lit(1)), *[F.avg(f"c{k}") for k in range(p)]).collect()
    centre = {r[0]: np.array(r[2:], float) for r in means}

    def products(batches):
        total = {g: np.zeros((p, p)) for g in centre}
        for batch in batches:
            of, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack(values)
            for g in np.unique(of):
                z = x[of == g] - centre[g]
                total[g] += z.T @ z
        for g, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), g), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(t[i, j])],
                                             names=["g", "i", "j", "sxy"])

    cross = {g: np.zeros((p, p)) for g in centre}
    for r in data.mapInArrow(products, "g int, i int, j int, sxy double").groupBy("g", "i", "j").agg(F.sum("sxy").alias("sxy")).collect():
        cross[r.g][r.i, r.j] = cross[r.g][r.j, r.i] = r.sxy
    return {r[0]: (float(r[1]), centre[r[0]], cross[r[0]]) for r in means}


def merged_moments(groups) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and centred cross products of several groups together."""
    groups = list(groups)
    n = sum(g[0] for g in groups)
    if not n:
        raise ValueError("no rows")
    mean = sum(g[0] * g[1] for g in groups) / n
    return n, mean, sum(c + m * np.outer(at - mean, at - mean) for m, at, c in groups)
