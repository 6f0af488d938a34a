"""Prediction, ranking and top-k.

Top-k uses ``orderBy(...).limit(n)``, which plans as TakeOrderedAndProject:
every partition keeps its own best n and only n·partitions rows reach the
final merge. Ranks are numbered after the limit, over n rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.windows import KEY, TIME


def latest_rows(df: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """Newest row per instrument. A hash aggregate finds each instrument's newest time (one row
    for each task and instrument is shuffled); the rows of that time come back by join, which needs no
    sort of the panel. One row stays of rows that are equal in key and time."""
    ends = df.groupBy(key).agg(F.max(time).alias("_newest")).withColumnRenamed(key, "_of")
    newest = df.join(ends, F.col(key).eqNullSafe(F.col("_of")) & F.col(time).eqNullSafe(F.col("_newest"))).drop("_of", "_newest")
    return newest.dropDuplicates([key])


def predict_price(df: DataFrame, ret: str = "predicted_return", price: str = "close",
                  at=None) -> DataFrame:
    """Q1: ``predicted_price = current_price · (1 + predicted_return)``, stamped."""
    out = df.withColumns({"current_price": F.col(price),
                          "predicted_price": F.col(price) * (1 + F.col(ret))})
    if at is not None:
        out = out.withColumn("prediction_time", F.lit(at).cast("timestamp_ntz"))
    return out


def top_bottom(df: DataFrame, n: int = 10, score: str = "predicted_return", key: str = KEY,
               return_type: str = "both") -> DataFrame:
    """Q2: gainers (highest ``score``) and losers (lowest), ranked 1..n each.

    Ties break on the instrument code: ascending among gainers, descending
    among losers (the losers are the tail of the gainers' order).
    """
    parts = []
    if return_type in ("top", "both"):
        top = df.orderBy(F.col(score).desc_nulls_last(), F.col(key).asc()).limit(n)
        parts.append(top.withColumns({
            "rank": F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), F.col(key).asc())),
            "category": F.lit("top_gainers")}))
    if return_type in ("bottom", "both"):
        bot = (df.where(F.col(score).isNotNull())
               .orderBy(F.col(score).asc(), F.col(key).desc()).limit(n))
        parts.append(bot.withColumns({
            "rank": F.row_number().over(Window.orderBy(F.col(score).asc(), F.col(key).desc())),
            "category": F.lit("top_losers")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def submission(df: DataFrame, n: int = 10, score: str = "predicted_return") -> DataFrame:
    """K3 content: ``stock_code, predicted_return, rank, category``."""
    return top_bottom(df, n, score).select(KEY, score, "rank", "category")


def submission_record(ranked: DataFrame, score: str = "predicted_return") -> DataFrame:
    """K6: both sides as one nested record (arrays ordered by rank).

    ``ranked`` is the output of :func:`top_bottom`: at most 2·n rows."""
    def side(cat):
        return F.sort_array(F.collect_list(
            F.when(F.col("category") == cat, F.struct("rank", KEY, score))))
    return (ranked.agg(side("top_gainers").alias("g"), side("top_losers").alias("l"))
            .select(F.col(f"g.{KEY}").alias("top_gainers_codes"),
                    F.col(f"g.{score}").alias("top_gainers_returns"),
                    F.col(f"l.{KEY}").alias("top_losers_codes"),
                    F.col(f"l.{score}").alias("top_losers_returns")))


def prediction_stats(df: DataFrame, c: str = "predicted_return") -> DataFrame:
    """Q3: count, mean, sample std, extremes, sign counts, quantiles."""
    from barlake.functions.quantiles import quantile_literals
    x = F.col(c)
    qv = quantile_literals(df, [c], [0.05, 0.25, 0.5, 0.75, 0.95])[c]
    return (df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                   F.min(x).alias("min"), F.max(x).alias("max"),
                   F.count_if(x > 0).alias("positive_count"), F.count_if(x < 0).alias("negative_count"),
                   F.count_if(x == 0).alias("zero_count"))
            .select("*", *[F.lit(v).cast("double").alias(f"q{p}") for v, p in zip(qv, (5, 25, 50, 75, 95))]))


def prediction_listing(ranked: DataFrame, score: str = "predicted_return") -> DataFrame:
    """Q4: formatted return and percent for the ranked lists."""
    return ranked.select("category", "rank", KEY,
                         F.format_number(F.col(score), 4).alias("return_text"),
                         F.concat(F.format_number(F.col(score) * 100, 2), F.lit("%")).alias("percent_text"))


def zero_uncertainty(df: DataFrame, out: str = "uncertainty") -> DataFrame:
    """The default of models that cannot tell: no uncertainty, on every row."""
    return df.withColumn(out, F.lit(0.0))


def confidence(df: DataFrame, u: str = "uncertainty", threshold: float | None = None) -> DataFrame:
    """``confidence = 1 - u / (max u + 1e-8)``, ``high_confidence = u < 0.05``."""
    mx = df.agg(F.max(u)).scalar()
    out = df.withColumns({"confidence": 1 - F.col(u) / (mx + 1e-8),
                          "high_confidence": F.col(u) < 0.05})
    if threshold is not None:
        out = out.where(F.col("confidence") >= threshold)
    return out


def ensemble_average(df: DataFrame, cols: list[str], out: str = "ensemble") -> DataFrame:
    """Mean of the non-null model predictions (failed models skipped)."""
    arr = F.filter(F.array(*[F.col(c) for c in cols]), lambda x: x.isNotNull())
    return df.withColumn(out, F.try_divide(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), F.size(arr)))


def ensemble_weighted(df: DataFrame, weights: dict, out: str = "ensemble") -> DataFrame:
    """``Σ w·p / Σ w`` over present predictions; a missing weight counts 1."""
    num = den = F.lit(0.0)
    for c, w in weights.items():
        w = 1.0 if w is None else float(w)
        num = num + F.coalesce(F.col(c) * w, F.lit(0.0))
        den = den + F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0)
    return df.withColumn(out, F.try_divide(num, den))


def ensemble_median(df: DataFrame, cols: list[str], out: str = "ensemble") -> DataFrame:
    """Median of the non-null predictions (mean of the middle two if even)."""
    s = F.array_sort(F.filter(F.array(*[F.col(c) for c in cols]), lambda x: x.isNotNull()))
    n = F.size(s)
    mid = F.when(n % 2 == 1, F.element_at(s, (n / 2).cast("int") + 1)).otherwise(
        (F.element_at(s, (n / 2).cast("int")) + F.element_at(s, (n / 2).cast("int") + 1)) / 2)
    return df.withColumn(out, F.when(n > 0, mid))
