"""Feature selection over one global feature matrix.

Scores are computed by single aggregates over all rows (one pass per method)
and returned as a long score table ``(method, feature, score, rank, selected)``.
Only the p-sized score table ever reaches the driver (for the feature list).

Re-aimed: the reference's kNN mutual-information estimator is replaced by a
plug-in estimate on equal-frequency bins (one groupBy over bin pairs), which
scales with the data; RFE / lasso / importance use Spark ML estimators.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.windows import safe_corr
from barlake.operators.clean import median_impute


def _long(wide: DataFrame, features: list[str], value: str) -> DataFrame:
    return wide.unpivot([], features, "feature", value)


def _ranked(scores: DataFrame, score: str, k: int | None = None, threshold: float | None = None,
            method: str = "") -> DataFrame:
    w = Window.partitionBy(F.lit(method)).orderBy(F.col(score).desc_nulls_last(), F.col("feature"))
    out = scores.withColumn("rank", F.row_number().over(w))
    sel = F.lit(True)
    if k is not None:
        sel = sel & (F.col("rank") <= k)
    if threshold is not None:
        sel = sel & (F.col(score) >= threshold)
    return out.withColumns({"selected": F.coalesce(sel, F.lit(False)), "method": F.lit(method)})


def correlation_scores(df: DataFrame, features: list[str], label: str, threshold: float = 0.1,
                       top_k: int | None = None) -> DataFrame:
    """L1 (+N3 with ``top_k``): |Pearson(feature, label)| over complete pairs."""
    wide = df.agg(*[F.abs(safe_corr(f, label)).alias(f) for f in features])
    return _ranked(_long(wide, features, "score"), "score", top_k, threshold, "correlation")


def f_scores(df: DataFrame, features: list[str], label: str, k: int = 50) -> DataFrame:
    """L3: F = r² / (1 - r²) · (n - 2) on median-imputed features."""
    imp = median_impute(df.where(F.col(label).isNotNull()), features)
    wide = imp.agg(F.count(F.lit(1)).alias("_n"), *[safe_corr(f, label).alias(f) for f in features])
    long = wide.unpivot(["_n"], features, "feature", "r")
    f = F.try_divide(F.col("r") ** 2, 1 - F.col("r") ** 2) * (F.col("_n") - 2)
    return _ranked(long.withColumn("score", f).drop("_n", "r"), "score", k, None, "f_score")


def mutual_info_binned(df: DataFrame, features: list[str], label: str, k: int = 50,
                       bins: int = 10) -> DataFrame:
    """L2 (re-aimed): plug-in MI of equal-frequency bins of feature and label.

    Bin = number of interior quantile edges strictly below the value. All
    features are binned in one projection, unpivoted, and counted in one
    aggregate keyed by (feature, bin_x, bin_y).
    """
    data = median_impute(df.where(F.col(label).isNotNull()), features)
    from barlake.functions.quantiles import quantile_literals
    # (features + 1) × (bins - 1) numbers: a bounded statistic, fetched once
    # and inlined as literals (the same split as ML's QuantileDiscretizer).
    edges = quantile_literals(data, features + [label], [i / bins for i in range(1, bins)])

    def bin_of(c):
        e = edges[c] or []
        below = [F.when(F.lit(float(q)) < F.col(c), 1).otherwise(0) for q in e] or [F.lit(0)]
        total = below[0]
        for b in below[1:]:
            total = total + b
        return total

    binned = data.select(bin_of(label).alias("_by"), *[bin_of(f).alias(f) for f in features])
    long = binned.unpivot(["_by"], features, "feature", "_bx")
    joint = long.groupBy("feature", "_bx", "_by").agg(F.count(F.lit(1)).alias("_nxy"))
    wx = Window.partitionBy("feature", "_bx")
    wy = Window.partitionBy("feature", "_by")
    wn = Window.partitionBy("feature")
    j = joint.withColumns({"_nx": F.sum("_nxy").over(wx), "_ny": F.sum("_nxy").over(wy),
                           "_n": F.sum("_nxy").over(wn)})
    term = (F.col("_nxy") / F.col("_n")) * F.ln(F.col("_nxy") * F.col("_n") / (F.col("_nx") * F.col("_ny")))
    mi = j.groupBy("feature").agg(F.sum(term).alias("score"))
    return _ranked(mi, "score", k, None, "mutual_info")


def correlation_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    """All pairwise |Pearson| as ``(left, right, li, ri, corr)`` with left before right.

    Over the rows where both are present, for any number of features; null where fewer than
    two rows are or one of the two is constant there."""
    from barlake.functions.moments import cross_moments

    found, _ = cross_moments(df, list(features))
    names = F.array(*[F.lit(f) for f in features])
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / F.col("n"), F.col("syy") - F.col("sy") ** 2 / F.col("n")
    corr = F.abs((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    # a variance that is rounding noise of its own sum of squares counts as 0
    spread = (vx > 1e-14 * F.col("sxx")) & (vy > 1e-14 * F.col("syy"))
    return (found.where("i < j and n > 0")
            .select(names[F.col("i")].alias("left"), names[F.col("j")].alias("right"), F.col("i").alias("li"), F.col("j").alias("ri"),
                    F.when((F.col("n") > 1) & spread, F.least(corr, F.lit(1.0))).alias("corr")))


def remove_correlated(df: DataFrame, features: list[str], threshold: float = 0.9) -> DataFrame:
    """A feature is dropped when |corr| with any earlier feature exceeds the
    threshold (earlier features count even if they are dropped themselves)."""
    pairs = correlation_pairs(df, features)
    dropped = pairs.where(F.col("corr") > threshold).groupBy("right").agg(
        F.min("li").alias("because_of"))
    names = df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, idx int")
    return (names.join(dropped, names.feature == dropped.right, "left")
            .select("feature", "idx", F.col("because_of").isNull().alias("kept")))


def selected_features(scores: DataFrame) -> list[str]:
    """The selected names in rank order (p rows reach the driver)."""
    return [r["feature"] for r in scores.where("selected").orderBy("rank").select("feature").collect()]


def select_features(df: DataFrame, features: list[str], label: str, method: str = "mutual_info",
                     corr_threshold: float = 0.9, **kw) -> tuple[list[str], DataFrame]:
    """Dispatch on the method name, then drop correlated survivors."""
    from barlake.operators import models as M
    methods = {
        "correlation": lambda: correlation_scores(df, features, label, **kw),
        "mutual_info": lambda: mutual_info_binned(df, features, label, **kw),
        "f_score": lambda: f_scores(df, features, label, **kw),
        "rfe": lambda: M.rfe_scores(df, features, label, **kw),
        "lasso": lambda: M.lasso_scores(df, features, label, **kw),
        "importance": lambda: M.importance_scores(df, features, label, **kw),
    }
    if method not in methods:
        raise ValueError(f"Unknown selection method: {method}")
    scores = methods[method]()
    chosen = selected_features(scores)
    if corr_threshold < 1.0 and len(chosen) > 1:
        kept = remove_correlated(df, chosen, corr_threshold).where("kept").orderBy("idx").collect()
        chosen = [r["feature"] for r in kept]
    return chosen, scores
