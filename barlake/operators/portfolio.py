"""Portfolio views of returns and predictions (N1 maximum drawdown, N7 long/short)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.ranks import top_n_per_group
from barlake.functions.windows import DEFAULT, KEY, TIME, PanelSpec


def max_drawdown(df: DataFrame, ret: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per instrument, min of equity / running peak - 1 (peak includes the
    starting capital), equity = Π(1 + r) in date order, via log sums. A return of
    -1 or less leaves nothing: equity is 0 from there on, a drawdown of -1."""
    lg = F.sum(F.when(F.col(ret) > -1, F.ln(1 + F.col(ret)))).over(spec.cumulative())
    lost = F.max(F.coalesce(F.col(ret) <= -1, F.lit(False))).over(spec.cumulative())
    out = df.withColumns({"_lg": lg, "_lost": lost})
    peak = F.greatest(F.lit(0.0), F.max("_lg").over(spec.cumulative()))
    out = out.withColumn("_dd", F.when(F.col("_lost"), F.lit(-1.0)).otherwise(F.exp(F.col("_lg") - peak) - 1))
    return out.groupBy(*spec.keys).agg(F.min("_dd").alias("max_drawdown"))


def long_short(df: DataFrame, score: str, ret: str, n: int = 10, time: str = TIME,
               key: str = KEY) -> DataFrame:
    """Per date, mean next return of the n best scores minus the n worst.

    Both sides use the salted top-n so a date with a huge cross-section is
    ranked in bounded pieces.
    """
    x = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    top = top_n_per_group(x, [time], [F.col(score).desc(), F.col(key).asc()], n, salt_col=key)
    bot = top_n_per_group(x, [time], [F.col(score).asc(), F.col(key).desc()], n, salt_col=key)
    t = top.groupBy(time).agg(F.avg(ret).alias("long_return"))
    b = bot.groupBy(time).agg(F.avg(ret).alias("short_return"))
    return t.join(b, time).withColumn("long_short", F.col("long_return") - F.col("short_return"))
