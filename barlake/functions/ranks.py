"""Distributed ranks, positions and top-n per group without single-task sorts.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task.
These helpers keep ordering work partitioned:

* :func:`value_counts` — rows below each distinct value: ties counted before they move, the
  distinct values ordered in ranges between percentiles of a sketch, plus the totals of the earlier
  ranges; :func:`average_rank` joins the mean positions of ties to the rows.
* :func:`top_n_per_group` — the best n of each salted sub-group, then the
  best n of those candidates: exact (the group's top n is contained in the
  union of its buckets' top n) and no task sees more than one bucket.
* :func:`date_offsets` — positions in (time, key) order from per-time counts
  and a running sum over the distinct times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


RANGES = 64  # parts of a group whose values are ordered independently


def value_counts(df: DataFrame, col: str, by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """``(*by, value, n, below)``: each distinct value of a group, its rows and the rows of smaller values.

    Lazy: no job runs while the plan is built. Ties are added up before they move. The distinct
    values are cut into ranges at percentiles of a sketch (one array for each group, part of the
    plan), each range is ordered by itself, and the ranges' totals are summed up. Rows with
    a null value or group are left out.
    """
    by = list(by or [])
    there = F.col(col).isNotNull()
    for k in by:
        there = there & F.col(k).isNotNull()
    counts = df.where(there).groupBy(*by, F.col(col).alias("value")).agg(F.count("*").alias("n"))
    cuts = [i / ranges for i in range(1, ranges)]
    splitters = counts.groupBy(*by).agg(F.percentile_approx(F.col("value").cast("double"), cuts, 50 * ranges).alias("_s"))
    placed = counts.join(splitters, by) if by else counts.withColumn("_s", splitters.scalar())
    placed = placed.withColumn("_range", F.size(F.filter("_s", lambda s: s < F.col("value").cast("double")))).drop("_s")
    inside = Window.partitionBy(*by, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_range").agg(F.sum("n").alias("_t"))  # at most `ranges` rows for each group
    totals = totals.select(*by, "_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    return placed.join(totals, [*by, "_range"]).select(*by, "value", "n", (F.col("_off") + F.col("_in")).alias("below"))


def average_rank(df: DataFrame, col: str, by: list[str] | None = None, out: str = "rank", ranges: int = RANGES) -> DataFrame:
    """1-based rank of ``col`` (ascending) inside each ``by`` group, ties averaged, null for nulls.

    Rows meet the ranks of the distinct values in an equi-join, in which adaptive execution
    splits a value that many rows hold (each value is one row on the other side)."""
    by = list(by or [])
    ranks = value_counts(df, col, by, ranges).select(*[F.col(k).alias(f"_of_{k}") for k in by], "value", (F.col("below") + (F.col("n") + 1) / 2.0).alias(out))
    same = F.col(col) == F.col("value")
    for k in by:
        same = same & (F.col(k) == F.col(f"_of_{k}"))
    return df.join(ranks, same, "left").drop("value", *[f"_of_{k}" for k in by])


def top_n_per_group(df: DataFrame, group: list[str], order: list, n: int, out: str = "rank",
                    salt_col: str | None = None, buckets: int = 16) -> DataFrame:
    """Rows ranked 1..n inside each group by ``order`` (Column expressions).

    A hot group is split into ``buckets`` sub-groups by a hash of ``salt_col``
    (or of the whole row); each bucket keeps its own top n, and the final
    ranking runs over at most n·buckets candidates per group.
    """
    salt = F.xxhash64(F.col(salt_col)) if salt_col else F.xxhash64(*[F.col(c) for c in df.columns])
    b = df.withColumn("_b", F.pmod(salt, F.lit(buckets)))
    w1 = Window.partitionBy(*group, "_b").orderBy(*order)
    cand = b.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n).drop("_r1", "_b")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return cand.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= n)


def date_offsets(df: DataFrame, time: str, key: str, out: str = "pos", by: list[str] | None = None,
                 total: str | None = None) -> DataFrame:
    """0-based position in (time, key) order, per ``by`` group, and the group's rows as ``total``.

    Offsets come from a running sum over the per-time row counts (one row per
    distinct (group, time), a small table); inside a time the position is the
    key order, so no task ever sorts a whole group.
    """
    by = list(by or [])
    per = df.groupBy(*by, time).agg(F.count(F.lit(1)).alias("_c"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(time) \
        .rowsBetween(Window.unboundedPreceding, -1)
    if total:
        per = per.withColumn(total, F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    per = per.withColumn("_o", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    inner = Window.partitionBy(*by, time).orderBy(key)
    return (df.join(per, [*by, time]).withColumn(out, F.col("_o") + F.row_number().over(inner) - 1)
            .drop("_o"))
