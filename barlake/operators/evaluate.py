"""Evaluation of predictions (V1-V19) over a long frame ``(model, keys, y, p)``.

All models are evaluated by one ``groupBy(model)`` aggregate; nothing is
collected per model. Position-based metrics (information ratio, Q-Q points)
use distributed positions from :mod:`barlake.functions.ranks`.

Fixed values: MAPE guards |y| with the float64 machine epsilon
2.220446049250313e-16; information-ratio windows are 20 rows with stride 5;
the quintile cuts are 0.2, 0.4, 0.6, 0.8 (four layers, top fifth omitted);
the top-N portfolio takes N = min(10, n // 10) rows (all rows when N = 0).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.ranks import average_rank, date_offsets, top_n_per_group, value_counts
from barlake.functions.windows import KEY, TIME, safe_corr

EPS64 = 2.220446049250313e-16


def _e(y, p):
    return F.col(y) - F.col(p)


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", by=("model",), n_features: int = 1) -> DataFrame:
    """V1-V4, V6, V7, V9 (+ V5 via :func:`spearman`) as one aggregate per model."""
    e = _e(y, p)
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("_vy"),
        F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(EPS64))).alias("mape"),
        safe_corr(y, p).alias("pearson_corr"),
        F.max(F.abs(e)).alias("max_error"),
        F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("direction_accuracy"),
    )
    from barlake.functions.quantiles import quantiles
    med = (quantiles(df.withColumn("_ae", F.abs(e)), ["_ae"], [0.5], list(by))
           .select(*by, F.col("value").alias("median_ae")))
    agg = agg.join(med, list(by), "left")
    r2 = 1 - F.try_divide(F.col("mse"), F.col("_vy"))
    k = float(n_features)
    adj = F.when(F.col("n") > k + 1, 1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - k - 1)).otherwise(r2)
    return (agg.withColumns({"rmse": F.sqrt("mse"), "r2": r2, "adj_r2": adj,
                             "information_coefficient": F.col("pearson_corr")})
            .drop("_vy"))


def spearman(df: DataFrame, y: str = "y", p: str = "p", by=("model",)) -> DataFrame:
    """V5: Pearson correlation of average ranks (ties averaged), per model."""
    r = average_rank(df, y, list(by), "_ry")
    r = average_rank(r, p, list(by), "_rp")
    return r.groupBy(*by).agg(safe_corr("_ry", "_rp").alias("spearman_corr"))


def quintile_accuracy(df: DataFrame, y: str = "y", p: str = "p", by=("model",)) -> DataFrame:
    """V8: direction accuracy inside return layers q1..q4 (cuts at .2/.4/.6/.8)."""
    from barlake.functions.quantiles import quantiles
    qs = quantiles(df, [y], [0.2, 0.4, 0.6, 0.8], list(by))
    cuts = qs.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("q", "value"))).alias("_s")) \
        .select(*by, F.col("_s.value").alias("_q"))
    j = df.join(cuts, list(by))
    yy = F.col(y)
    layer = (F.when(yy <= F.col("_q")[0], "q1").when(yy <= F.col("_q")[1], "q2")
             .when(yy <= F.col("_q")[2], "q3").when(yy <= F.col("_q")[3], "q4"))
    return (j.withColumn("layer", layer).where(F.col("layer").isNotNull())
            .groupBy(*by, "layer")
            .agg(F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("accuracy"),
                 F.count(F.lit(1)).alias("n")))


def information_ratio(df: DataFrame, y: str = "y", p: str = "p", by=("model",), time: str = TIME, key: str = KEY,
                      window: int = 20, stride: int = 5, strip: int = 4096) -> DataFrame:
    """IC over all rows / population std of ICs of 20-row windows (stride 5).

    Windows start at 0, 5, ... while start < n - 20. Rows are gathered once, by (time, key)
    position, into pieces of ``stride`` rows; a window is ``window / stride`` pieces in a row. Pieces
    are joined up in strips of ``strip``, each of which also gets the first pieces of the next
    (three in 4096), so no row is copied for every window it is in. Windows with an undefined
    IC are skipped; the ratio is 0 when the spread is 0 or undefined.
    """
    if window % stride:
        raise ValueError("window must be a multiple of stride")
    by, parts = list(by), window // stride
    pos = date_offsets(df, time, key, "_pos", by, total="_n")
    pieces = pos.groupBy(*by, "_n", F.floor(F.col("_pos") / stride).alias("_piece")).agg(
        F.collect_list(F.struct(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"))).alias("_rows"),
        F.coalesce(F.min(F.col(y).cast("double")), F.lit(0.0)).alias("_y0"), F.coalesce(F.min(F.col(p).cast("double")), F.lit(0.0)).alias("_p0"))
    own = F.floor(F.col("_piece") / strip)
    into = F.when((F.col("_piece") % strip < parts - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    strips = pieces.withColumn("_strip", F.explode(into))
    ahead = Window.partitionBy(*by, "_strip").orderBy("_piece").rowsBetween(0, parts - 1)
    windows = strips.withColumn("_w", F.collect_list("_rows").over(ahead)).where(
        (own == F.col("_strip")) & (F.col("_piece") * stride < F.col("_n") - window))

    # one pass over a window's rows: moments of differences from a value of its first piece, so
    # that a constant column has no spread at all, not a rounded one
    names = ("n", "y", "p", "yy", "pp", "yp")

    def add(m, r):
        dy, dp = r["y"] - F.col("_y0"), r["p"] - F.col("_p0")
        new = F.struct(*[(m[k] + v).alias(k) for k, v in zip(names, (F.lit(1.0), dy, dp, dy * dy, dp * dp, dy * dp))])
        return F.when(r["y"].isNull() | r["p"].isNull(), m).otherwise(new)

    def corr(m):
        def about(ab, a, b):
            return m[ab] - F.try_divide(m[a] * m[b], m["n"])
        yy, pp = about("yy", "y", "y"), about("pp", "p", "p")
        return F.when((yy > 0) & (pp > 0), about("yp", "y", "p") / F.sqrt(yy * pp))

    zero = F.struct(*[F.lit(0.0).alias(k) for k in names])
    ics = windows.select(*by, F.aggregate(F.flatten("_w"), zero, add, corr).alias("_ic")).where("_ic is not null")
    spreads = ics.groupBy(*by).agg(F.stddev_pop("_ic").alias("ic_std"), F.count("_ic").alias("n_windows"))
    out = df.groupBy(*by).agg(safe_corr(y, p).alias("information_coefficient")).join(spreads, by, "left")
    ir = F.when(F.col("ic_std") > 0, F.col("information_coefficient") / F.col("ic_std")).otherwise(F.lit(0.0))
    return out.withColumn("information_ratio", ir)


def portfolio_metrics(df: DataFrame, y: str = "y", p: str = "p", by=("model",), cap: int = 10,
                      tie=None) -> DataFrame:
    """Mean true return of the N best predictions and its mean/std ratio.

    Ties among equal predictions break on (date, instrument) descending."""
    by = list(by)
    tie = tie if tie is not None else (F.col(TIME).desc(), F.col(KEY).desc())
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = top_n_per_group(df, by, [F.col(p).desc(), *tie], cap, out="_r", salt_col=None)
    j = ranked.join(n, by).where(
        (F.col("_r") <= F.least(F.lit(cap), (F.col("_n") / 10).cast("long"))))
    small = n.where(F.col("_n") < 10).select(*by)
    everything = df.join(small, by, "left_semi")
    pick = j.select(*df.columns).unionByName(everything)
    agg = pick.groupBy(*by).agg(F.avg(y).alias("portfolio_return"), F.stddev_pop(y).alias("_sd"),
                                F.count(F.lit(1)).alias("top_n"))
    return agg.withColumn("sharpe_ratio", F.when(F.col("_sd") > 0, F.col("portfolio_return") / F.col("_sd"))
                          .otherwise(F.lit(0.0))).drop("_sd")


def jarque_bera(df: DataFrame, y: str = "y", p: str = "p", by=("model",)) -> DataFrame:
    """JB = n/6 (S² + K²/4) with population skewness/excess kurtosis; p = exp(-JB/2)."""
    e = _e(y, p)
    a = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.skewness(e).alias("skewness"),
                            F.kurtosis(e).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4.0)
    return (a.withColumn("jarque_bera", jb).withColumn("jb_pvalue", F.exp(-F.col("jarque_bera") / 2))
            .withColumn("residuals_normal", F.col("jb_pvalue") > 0.05))


def durbin_watson(df: DataFrame, y: str = "y", p: str = "p", by=("model",), key: str = KEY,
                  time: str = TIME) -> DataFrame:
    """Σ(e_t - e_{t-1})² / Σe² with the lag taken inside each instrument."""
    e = _e(y, p)
    w = Window.partitionBy(*by, key).orderBy(time)
    d = df.withColumn("_e", e).withColumn("_de", F.col("_e") - F.lag("_e").over(w))
    a = d.groupBy(*by).agg(F.sum(F.col("_de") ** 2).alias("_num"), F.sum(F.col("_e") ** 2).alias("_den"))
    dw = F.try_divide(F.col("_num"), F.col("_den"))
    return a.select(*by, dw.alias("durbin_watson"),
                    ((dw >= 1.5) & (dw <= 2.5)).alias("no_autocorrelation"))


@F.pandas_udf(T.DoubleType())
def _chi2_1_sf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(math.sqrt(v / 2.0)) if v is not None and v == v and v >= 0 else None)


def breusch_pagan(df: DataFrame, y: str = "y", p: str = "p", by=("model",), with_pvalue: bool = True) -> DataFrame:
    """LM = n·R² of e² on the prediction (with intercept), χ²(1) p-value."""
    e2 = _e(y, p) ** 2
    a = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_r2(e2, F.col(p)).alias("bp_r2"))
    a = a.withColumn("bp_lm", F.col("n") * F.col("bp_r2"))
    if with_pvalue:
        a = a.withColumn("bp_pvalue", _chi2_1_sf("bp_lm")).withColumn(
            "homoscedastic", F.col("bp_pvalue") > 0.05)
    return a


def residual_histogram(df: DataFrame, y: str = "y", p: str = "p", by=("model",), bins: int = 30) -> DataFrame:
    """30 equal-width bins over [min, max] of the residuals with densities."""
    by = list(by)
    e = df.withColumn("_e", _e(y, p))
    rng = e.groupBy(*by).agg(F.min("_e").alias("_lo"), F.max("_e").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    j = e.join(rng, by)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor(F.try_divide(F.col("_e") - F.col("_lo"), width)) + 1, F.lit(bins))
    j = j.withColumn("bin", F.when(width > 0, b).otherwise(F.lit(1)).cast("long"))
    h = j.groupBy(*by, "bin", "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("count"))
    return h.select(*by, "bin",
                    (F.col("_lo") + (F.col("bin") - 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"),
                    "count",
                    F.try_divide(F.col("count"), F.col("_n") * (F.col("_hi") - F.col("_lo")) / bins).alias("density"))


def residual_qq(df: DataFrame, y: str = "y", p: str = "p", by=("model",), piece: int = 4096) -> DataFrame:
    """Ordered residuals with plotting positions (i - 0.5) / n and the
    fitted normal's mean / population std.

    A residual that c rows share is one row until its c positions are written out, ``piece`` at a
    time; no row of the data is ranked."""
    by = list(by)
    e = df.withColumn("residual", _e(y, p))
    st = e.groupBy(*by).agg(F.count("residual").alias("_n"), F.avg("residual").alias("fit_mean"),
                            F.stddev_pop("residual").alias("fit_std"))
    counts = value_counts(e, "residual", by).withColumnRenamed("value", "residual")
    pieces = counts.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(piece).cast("bigint"))))
    upto = F.least(F.col("n"), F.col("_from") + piece)
    rows = pieces.withColumn("i", F.explode(F.sequence(F.col("below") + F.col("_from") + 1, F.col("below") + upto)))
    return (rows.join(st, by).select(*by, "i", "residual", ((F.col("i") - 0.5) / F.col("_n")).alias("plotting_position"),
                                     "fit_mean", "fit_std"))


def model_ranking(metrics: DataFrame, metric: str = "rmse", by: str = "model") -> DataFrame:
    """Summary ordered by rmse and numbered (one row per model)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(metric).asc_nulls_last(), F.col(by))
    return metrics.withColumn("rank", F.row_number().over(w))


def evaluate_all(df: DataFrame, y: str = "y", p: str = "p", by=("model",)) -> DataFrame:
    """Every scalar metric of every model in one wide row per model."""
    by = list(by)
    out = regression_metrics(df, y, p, by)
    for extra in (spearman(df, y, p, by), information_ratio(df, y, p, by).drop("information_coefficient"),
                  portfolio_metrics(df, y, p, by)):
        out = out.join(extra, by, "left")
    return model_ranking(out)
