"""Exact quantiles without holding a column in one task, and without a sort of all rows.

Three lazy steps, no job while the plan is built:

1. ``approx_percentile`` (a mergeable sketch) brackets each requested quantile per group and
   column; groups of under 100,000 values need no bracket.
2. One aggregate counts the values below each bracket and, inside it, the rows of each distinct
   value. Ties (zero returns, say) are added up before they move, however many rows hold them.
3. A running sum over the few distinct values inside a bracket finds the two around position
   ``q * (n - 1)``, and the linear interpolation of ``percentile`` and SQL ``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000        # the sketch's ranks are right to n / ACCURACY
BRACKETED = 100_000      # values of a group from which its bracket is used


def quantiles(df: DataFrame, cols: list[str], qs: list[float], by: list[str] | None = None) -> DataFrame:
    """Long table ``(*by, column, q, value)``: exact linear quantiles of the
    non-null values of each column (per ``by`` group)."""
    by = list(by or [])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    long = (df.select(*by, F.explode(items).alias("_x")).select(*by, "_x.column", "_x.value")
            .where(F.col("value").isNotNull()))
    keys = by + ["column"]
    margin = 4.0 / ACCURACY
    sketch = [F.percentile_approx("value", [max(0.0, q - margin), min(1.0, q + margin)], ACCURACY) for q in qs]
    targets = F.array(*[
        F.struct(F.lit(float(q)).alias("q"),
                 F.when(F.lit(q - margin > 0) & (F.count("*") >= BRACKETED), s[0]).alias("_from"),
                 F.when(F.lit(q + margin < 1) & (F.count("*") >= BRACKETED), s[1]).alias("_to"))
        for q, s in zip(qs, sketch)])
    brackets = (long.groupBy(*keys).agg(F.count("*").alias("_n"), targets.alias("_q"))
                .select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_n", F.inline("_q")))
    # a row for each distinct value inside a bracket, and one (null) for all values below it
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    near = (long.join(brackets, same).where(F.col("_to").isNull() | (F.col("value") <= F.col("_to")))
            .select(*keys, "q", "_n",
                    F.when(F.col("_from").isNull() | (F.col("value") >= F.col("_from")), F.col("value")).alias("_v"))
            .groupBy(*keys, "q", "_n", "_v").agg(F.count("*").alias("_c")))
    w = Window.partitionBy(*keys, "q").orderBy(F.col("_v").asc_nulls_first())
    placed = near.withColumn("_end", F.sum("_c").over(w)).withColumn("_at", F.col("q") * (F.col("_n") - 1))

    def value_at(position):
        return F.max(F.when((F.col("_end") - F.col("_c") <= position) & (position < F.col("_end")), F.col("_v")))

    found = placed.groupBy(*keys, "q", "_at").agg(value_at(F.floor("_at")).alias("_lo"), value_at(F.ceil("_at")).alias("_hi"))
    share = F.col("_at") - F.floor("_at")
    return found.select(*keys, "q", (F.col("_lo") + share * (F.col("_hi") - F.col("_lo"))).alias("value"))


def quantile_literals(df: DataFrame, cols: list[str], qs: list[float]) -> dict[str, list[float]]:
    """Global quantiles fetched to the driver: len(cols) × len(qs) numbers."""
    rows = quantiles(df, cols, qs).collect()
    out: dict[str, list[float]] = {c: [None] * len(qs) for c in cols}
    index = {float(q): i for i, q in enumerate(qs)}
    for r in rows:
        out[r["column"]][index[float(r["q"])]] = r["value"]
    return out
