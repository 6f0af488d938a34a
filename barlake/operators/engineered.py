"""Engineered features (F1-F18): price, volume, technical, lag and time groups.

The recursive members of this family (``ema_n``, adjusted-EWM MACD, Wilder
RSI) come from :mod:`barlake.operators.recursive`; :func:`engineer_features`
composes both parts over one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.windows import DEFAULT, TIME, PanelSpec, add_rolling, col, div, div_or_zero


def price_position(c: str, n: int, spec: PanelSpec) -> F.Column:
    """pandas ``rolling(n).rank(pct=True)`` of the newest value, ties averaged."""
    win = F.collect_list(col(c)).over(spec.trailing(n))
    cur = col(c)
    less = F.size(F.filter(win, lambda x: x < cur))
    equal = F.size(F.filter(win, lambda x: x == cur))
    return spec.full(n, c, (less + (equal + 1) / 2.0) / float(n))


def price_features(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """F1-F4."""
    out = {}
    hl = div("high", "low")
    for n in (1, 3, 5, 10, 20):
        out[f"return_{n}d"] = spec.pct_change("close", n)
        out[f"high_low_ratio_{n}d"] = spec.full(n, hl, F.avg(hl).over(spec.trailing(n)))
    for n in (10, 20, 50):
        out[f"price_position_{n}d"] = price_position("close", n, spec)
    out["amplitude"] = div(F.col("high") - F.col("low"), "close")
    return df.withColumns(out)


def volume_features(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """F5-F8."""
    out = {}
    for n in (1, 3, 5, 10):
        out[f"volume_change_{n}d"] = spec.pct_change("volume", n)
        out[f"volume_ma_{n}d"] = spec.mean("volume", n)
    out["volume_price_corr"] = spec.corr("volume", "close", 20)
    out["money_flow"] = F.col("volume") * F.col("close")
    return df.withColumns(out)


def kdj(df: DataFrame, spec: PanelSpec = DEFAULT, n: int = 9, sk: int = 3, sd: int = 3) -> DataFrame:
    """F14 as a three-step projection (nested windows need materialised inputs)."""
    out = add_rolling(df, spec, {"_hh": ("max", "high", n), "_ll": ("min", "low", n)})
    out = out.withColumn("_k_raw", 100.0 * div_or_zero(F.col("close") - F.col("_ll"), F.col("_hh") - F.col("_ll")))
    out = add_rolling(out, spec, {"_k": ("avg", "_k_raw", sk)})
    out = add_rolling(out, spec, {"d": ("avg", "_k", sd)})
    out = out.withColumn("k", F.when(F.col("d").isNotNull(), F.col("_k")))
    return out.withColumn("j", 3 * F.col("k") - 2 * F.col("d")).drop("_k_raw", "_k", "_hh", "_ll")


def bollinger_pop(df: DataFrame, n: int = 20, spec: PanelSpec = DEFAULT, suffix: str = "") -> DataFrame:
    """Bollinger bands with the population deviation, width and position."""
    m, s_ = f"_bbm{suffix}_{n}", f"_bbs{suffix}_{n}"
    out = add_rolling(df, spec, {m: ("avg", "close", n), s_: ("stddev_pop", "close", n)})
    mid, sd = F.col(m), F.col(s_)
    up, lo = mid + 2 * sd, mid - 2 * sd
    cols = {f"bb_upper{suffix}": up, f"bb_middle{suffix}": mid, f"bb_lower{suffix}": lo}
    cols[f"bb_position{suffix}"] = div(F.col("close") - lo, up - lo)
    if suffix:
        cols[f"bb_width{suffix}"] = div(up - lo, mid)
    return out.withColumns(cols).drop(m, s_)


def sma_features(df: DataFrame, spec: PanelSpec = DEFAULT, periods=(5, 10, 20, 50)) -> DataFrame:
    """F9."""
    return add_rolling(df, spec, {f"sma_{n}": ("avg", "close", n) for n in periods})


def lag_features(df: DataFrame, target: str = "close", lags=(1, 2, 3, 5, 10),
                 windows=(5, 10, 20), spec: PanelSpec = DEFAULT) -> DataFrame:
    """``<t>_lag_k`` and rolling mean/std/max/min of the target."""
    out = df.withColumns({f"{target}_lag_{k}": spec.lag(target, k) for k in lags})
    stats = {}
    for n in windows:
        stats[f"{target}_mean_{n}"] = ("avg", target, n)
        stats[f"{target}_std_{n}"] = ("stddev_samp", target, n)
        stats[f"{target}_max_{n}"] = ("max", target, n)
        stats[f"{target}_min_{n}"] = ("min", target, n)
    return add_rolling(out, spec, stats)


def lag_columns(df: DataFrame, columns: list[str], lags=(1, 2, 3),
                spec: PanelSpec = DEFAULT) -> DataFrame:
    """``<col>_lag<k>`` for many columns."""
    return df.withColumns({f"{c}_lag{k}": spec.lag(c, k) for c in columns for k in lags})


def time_features(df: DataFrame, c: str = TIME) -> DataFrame:
    """calendar parts with month/quarter start and end flags.

    A missing time column leaves the frame unchanged (reference behaviour)."""
    if c not in df.columns:
        return df
    d = F.to_date(col(c))
    m = F.month(d)
    return df.withColumns({
        "year": F.year(d), "month": m, "day": F.dayofmonth(d), "weekday": F.weekday(d),
        "quarter": F.quarter(d),
        "is_month_start": F.dayofmonth(d) == 1,
        "is_month_end": d == F.last_day(d),
        "is_quarter_start": (F.dayofmonth(d) == 1) & m.isin(1, 4, 7, 10),
        "is_quarter_end": (d == F.last_day(d)) & m.isin(3, 6, 9, 12),
    })


def engineer_features(df: DataFrame, spec: PanelSpec = DEFAULT, with_recursive: bool = True) -> tuple[DataFrame, list[str]]:
    """price → volume → technical → lag → time; returns (frame, new columns)."""
    from barlake.operators import recursive

    base = set(df.columns)
    out = price_features(df, spec)
    out = volume_features(out, spec)
    out = sma_features(out, spec)
    out = bollinger_pop(out, 20, spec)
    out = kdj(out, spec)
    out = lag_features(out, spec=spec)
    out = time_features(out)
    if with_recursive:
        out = recursive.apply_recursive(out, recursive.ENGINEERED, spec=spec)
    return out, [c for c in out.columns if c not in base]
