"""Skew-safe execution of per-instrument windows over very long series.

A window partitioned by instrument puts each instrument's whole history in
one task. That is fine for bars (bounded by the number of time buckets) but
not when one instrument holds a large share of a huge panel. Here the
history is cut into fixed-size row blocks:

1. position of every bar inside its instrument, without a per-instrument
   sort: row counts per (instrument, coarse time bucket) in one aggregate, a
   running sum over those counts (a small table), and a rank inside each
   bucket;
2. block = position // block_rows; the last ``lookback`` rows of every block
   are copied into the next block as a *halo*;
3. the operator runs with ``PanelSpec(keys=(instrument, block))`` and the halo
   rows are dropped afterwards.

Bounded look-back operators (rolling n, lags up to n) give exactly the
unblocked result when ``lookback`` covers their longest frame. Cumulative
operators (OBV, VWAP) use :func:`blocked_cumulative_sum`: per-block partial
sums plus the running total of the earlier blocks (a two-level scan).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.windows import KEY, TIME, PanelSpec

BLOCK = "_blk"
HALO = "_halo"
POS = "_pos"


def positions(df: DataFrame, bucket_seconds: int = 30 * 86400, key: str = KEY, time: str = TIME) -> DataFrame:
    """0-based position of each row inside its instrument (time order)."""
    b = df.withColumn("_bk", F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / bucket_seconds))
    counts = b.groupBy(key, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(key).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    inner = Window.partitionBy(key, "_bk").orderBy(time)
    return (b.join(offsets, [key, "_bk"]).withColumn(POS, F.col("_off") + F.row_number().over(inner) - 1)
            .drop("_off", "_bk"))


def with_blocks(df: DataFrame, lookback: int, block_rows: int, key: str = KEY, time: str = TIME,
                bucket_seconds: int = 30 * 86400) -> DataFrame:
    """Rows tagged with their block, plus halo copies of each block's tail."""
    if lookback > block_rows:
        raise ValueError("lookback must not exceed block_rows")
    p = positions(df, bucket_seconds, key, time)
    blk = (F.col(POS) / block_rows).cast("long")
    tail = F.pmod(F.col(POS), F.lit(block_rows)) >= block_rows - lookback
    copies = F.when(tail & F.lit(lookback > 0),
                    F.array(F.struct(blk.alias("b"), F.lit(False).alias("h")),
                            F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))))
    copies = copies.otherwise(F.array(F.struct(blk.alias("b"), F.lit(False).alias("h"))))
    return (p.withColumn("_c", F.explode(copies))
            .withColumns({BLOCK: F.col("_c.b"), HALO: F.col("_c.h")}).drop("_c"))


def run_blocked(df: DataFrame, fn: Callable[[DataFrame, PanelSpec], DataFrame], lookback: int,
                block_rows: int = 100_000, key: str = KEY, time: str = TIME,
                bucket_seconds: int = 30 * 86400) -> DataFrame:
    """Apply a bounded-lookback operator ``fn(df, spec)`` block-wise (exact)."""
    blocked = with_blocks(df, lookback, block_rows, key, time, bucket_seconds)
    out = fn(blocked, PanelSpec(keys=(key, BLOCK), order=time))
    return out.where(~F.col(HALO)).drop(BLOCK, HALO, POS)


def blocked_cumulative_sum(df: DataFrame, value, out: str, block_rows: int = 100_000, key: str = KEY,
                           time: str = TIME, bucket_seconds: int = 30 * 86400) -> DataFrame:
    """Running sum of ``value`` per instrument via per-block sums + block offsets."""
    value = F.col(value) if isinstance(value, str) else value
    p = positions(df, bucket_seconds, key, time).withColumn(BLOCK, (F.col(POS) / block_rows).cast("long"))
    p = p.withColumn("_v", value)
    tot = p.groupBy(key, BLOCK).agg(F.sum("_v").alias("_bs"))
    w = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_boff", F.coalesce(F.sum("_bs").over(w), F.lit(0.0))).drop("_bs")
    inner = Window.partitionBy(key, BLOCK).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return (p.join(off, [key, BLOCK]).withColumn(out, F.col("_boff") + F.sum("_v").over(inner))
            .drop("_v", "_boff", BLOCK, POS))


def blocked_window_indicators(df: DataFrame, block_rows: int = 100_000, lookback: int = 64) -> DataFrame:
    """T1-T28 window indicators, skew-safe: bounded ones block-wise with a
    halo, OBV / VWAP by the two-level cumulative scan."""
    from barlake.operators import technical as T

    def bounded(frame, spec):
        out = T.ma_indicators(frame, spec)
        out = T.momentum_indicators(out, spec)
        out = T.volatility_indicators(out, spec)
        out = T.aroon(out, 14, spec)
        out = T.volume_indicators(out, spec).drop("obv", "vwap")
        out = T.price_transforms(out)
        return T.candle_patterns(out, spec)

    res = run_blocked(df, bounded, lookback, block_rows)
    # OBV: signed volume needs the previous close, i.e. a one-row look-back
    signed = run_blocked(df.select(KEY, TIME, "close", "volume"), lambda f, s: f.withColumn(
        "_sv", F.when(s.diff("close").isNull(), F.col("volume"))
        .otherwise(F.signum(s.diff("close")) * F.col("volume"))), 1, block_rows)
    obv = blocked_cumulative_sum(signed, "_sv", "obv", block_rows).select(KEY, TIME, "obv")
    vc = blocked_cumulative_sum(df.select(KEY, TIME, "close", "volume"), F.col("volume") * F.col("close"),
                                "_cvc", block_rows)
    vwap = blocked_cumulative_sum(vc, "volume", "_cv", block_rows).select(
        KEY, TIME, F.try_divide(F.col("_cvc"), F.col("_cv")).alias("vwap"))
    return res.join(obv, [KEY, TIME]).join(vwap, [KEY, TIME])
