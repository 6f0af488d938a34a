"""Cleaning, null handling, outlier flags and scaling.

Global statistics (means, deviations, extremes) are computed with one
aggregate and attached through scalar subqueries (``DataFrame.scalar()``):
Catalyst merges all subqueries over the same plan into a single job and
inlines the results as literals, so no join, broadcast or cross product is
needed and nothing grows with the data except the partial aggregates.
Quantiles come from :mod:`barlake.functions.quantiles` (distributed, exact):
the exact ``percentile`` aggregate would hold every distinct value in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.windows import DEFAULT, KEY, TIME, PanelSpec, col

PRICE_COLS = ["open", "high", "low", "close"]
NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType,
                 T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in ex]


# -- P1-P6 -------------------------------------------------------------------

def drop_duplicates(df: DataFrame) -> DataFrame:
    """Drop rows equal in every column."""
    return df.dropDuplicates()


def cast_dates(df: DataFrame, c: str = TIME, daily: bool = True) -> DataFrame:
    """Date cast (sorting is the windows' job, not a global sort)."""
    return df.withColumn(c, F.to_date(c) if daily else F.col(c).cast("timestamp_ntz"))


def validity_condition(df: DataFrame) -> F.Column:
    """P3-P6 as one predicate; a null in any tested column fails the row."""
    cond = F.lit(True)
    present = set(df.columns)
    for c in PRICE_COLS:
        if c in present:
            cond = cond & (F.col(c) > 0)
    if {"high", "low"} <= present:
        cond = cond & (F.col("high") >= F.col("low")) & (F.col("low") <= F.col("high"))
    for c in ("open", "close"):
        if {"high", c} <= present:
            cond = cond & (F.col("high") >= F.col(c))
        if {"low", c} <= present:
            cond = cond & (F.col("low") <= F.col(c))
    if "volume" in present:
        cond = cond & (F.col("volume") >= 0)
    return F.coalesce(cond, F.lit(False))


def clean_bars(df: DataFrame, dedupe: bool = True) -> DataFrame:
    """P1 + P3-P6: the reference's ``clean_stock_data`` minus the global sort."""
    out = drop_duplicates(df) if dedupe else df
    return out.where(validity_condition(out))


# -- P7, P11-P13 ---------------------------------------------------------------

def null_census(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column with its null count (one aggregate, then unpivot)."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "nulls")


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """P11."""
    return df.na.drop(subset=subset)


def fill_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls → 0 in numeric columns."""
    return df.na.fill(0, subset=columns) if columns else df.na.fill(0)


def median_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median per column (linear quantile), computed distributed;
    the medians (one number per column) are inlined as literals."""
    from barlake.functions.quantiles import quantile_literals
    med = quantile_literals(df, columns, [0.5])
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(med[c][0]).cast("double")) for c in columns})


# -- P8-P10: per-instrument fills ---------------------------------------------

def forward_fill(df: DataFrame, columns: list[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Last non-null value carried forward inside each instrument."""
    return df.withColumns({c: F.last(c, ignorenulls=True).over(spec.cumulative())
                           for c in columns})


def backward_fill(df: DataFrame, columns: list[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Next non-null value carried backward inside each instrument."""
    return df.withColumns({c: F.last(c, ignorenulls=True).over(spec.reverse_cumulative())
                           for c in columns})


def interpolate(df: DataFrame, columns: list[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """P10: linear interpolation by row position (pandas ``interpolate()``).

    Interior gaps are interpolated between the previous and next non-null
    values; leading nulls stay null; trailing nulls take the last value.
    """
    rn = "__rn"
    out = df.withColumn(rn, spec.row_number())
    fills = {}
    for c in columns:
        pv = F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(rn).alias("i"), F.col(c).alias("v"))),
                    ignorenulls=True).over(spec.cumulative())
        nx = F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(rn).alias("i"), F.col(c).alias("v"))),
                    ignorenulls=True).over(spec.reverse_cumulative())
        lerp = pv["v"] + (nx["v"] - pv["v"]) * (F.col(rn) - pv["i"]) / (nx["i"] - pv["i"])
        fills[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                    .when(pv.isNull(), F.lit(None))
                    .when(nx.isNull(), pv["v"])
                    .otherwise(lerp))
    return out.withColumns(fills).drop(rn)


def handle_missing(df: DataFrame, method: str = "forward_fill", columns: list[str] | None = None,
                   spec: PanelSpec = DEFAULT) -> DataFrame:
    """Dispatcher of P8-P11; an unknown method falls back to forward fill."""
    cols = columns or numeric_columns(df, exclude=[KEY])
    if method == "backward_fill":
        return backward_fill(df, cols, spec)
    if method == "interpolate":
        return interpolate(df, cols, spec)
    if method == "drop":
        return drop_nulls(df)
    return forward_fill(df, cols, spec)


# -- P14-P16: outlier flags ------------------------------------------------------

def iqr_outliers(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """``<c>_outlier`` outside [Q1 - k·IQR, Q3 + k·IQR] (exact linear quantiles)."""
    from barlake.functions.quantiles import quantile_literals
    stats = quantile_literals(df, columns, [0.25, 0.75])
    flags = {}
    for c in columns:
        q = [F.lit(v).cast("double") for v in stats[c]]
        iqr = q[1] - q[0]
        flags[f"{c}_outlier"] = F.coalesce((F.col(c) < q[0] - k * iqr) | (F.col(c) > q[1] + k * iqr),
                                           F.lit(False))
    return df.withColumns(flags)


def zscore_outliers(df: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """``|x - mean| / std_pop > threshold``; null or zero spread → False."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                     for c in columns])
    flags = {}
    for c in columns:
        s = stats.select(c).scalar()
        z = F.try_divide(F.abs(F.col(c) - s["m"]), s["s"])
        flags[f"{c}_outlier"] = F.coalesce(z > threshold, F.lit(False))
    return df.withColumns(flags)


def outlier_counts(flagged: DataFrame, columns: list[str]) -> DataFrame:
    """Number of flagged rows per column, long form."""
    wide = flagged.agg(*[F.count_if(F.col(f"{c}_outlier")).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "outliers")


# -- P17-P18: scaling -------------------------------------------------------------

def fit_standard(df: DataFrame, columns: list[str]) -> DataFrame:
    """One-row frame of (mean, population std) per column: the fitted scaler."""
    return df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                    for c in columns])


def apply_standard(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    out = {}
    for c in columns:
        s = stats.select(c).scalar()
        scale = F.when((s["s"].isNull()) | (s["s"] == 0), F.lit(1.0)).otherwise(s["s"])
        out[c] = (F.col(c) - s["m"]) / scale
    return df.withColumns(out)


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(x - mean) / std_pop``; a constant column scales by 1."""
    return apply_standard(df, fit_standard(df, columns), columns)


def fit_minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns])


def apply_minmax(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    out = {}
    for c in columns:
        s = stats.select(c).scalar()
        out[c] = F.when(s["hi"] == s["lo"], F.lit(0.0)).otherwise(
            (F.col(c) - s["lo"]) / (s["hi"] - s["lo"]))
    return df.withColumns(out)


def minmax_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """To [0, 1]; a constant column maps to 0."""
    return apply_minmax(df, fit_minmax(df, columns), columns)


def scale(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    return minmax_scale(df, columns) if method == "minmax" else standard_scale(df, columns)


# -- P19 ---------------------------------------------------------------------------

def feature_columns(df: DataFrame, target: str | None = None,
                    exclude_prefixes: Iterable[str] = ("target_",),
                    keys: Iterable[str] = (KEY, TIME), keep: Iterable[str] | None = None) -> list[str]:
    """Numeric non-key, non-target columns, optionally ∩ a saved list."""
    skip = set(keys) | ({target} if target else set())
    cols = [c for c in numeric_columns(df) if c not in skip
            and not any(c.startswith(p) for p in exclude_prefixes)]
    if keep is not None:
        wanted = set(keep)
        cols = [c for c in cols if c in wanted]
    return cols


def null_rate_columns(df: DataFrame, threshold: float = 0.5,
                      columns: list[str] | None = None) -> DataFrame:
    """Per-column null share and whether it exceeds ``threshold``."""
    cols = list(columns or df.columns)
    n = F.count(F.lit(1))
    wide = df.agg(*[F.try_divide(F.count_if(F.col(c).isNull()), n).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "null_share")
    return long.withColumn("dropped", F.col("null_share") > threshold)


def drop_high_null_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop columns whose null share exceeds ``threshold`` (driver gets one row)."""
    shares = null_rate_columns(df, threshold).where("dropped").select("column").collect()
    return df.drop(*[r[0] for r in shares])


__all__ = [n for n in dir() if not n.startswith("_")] + ["col"]
