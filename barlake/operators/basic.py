"""Returns, basic indicators and calendar features.

Pandas-dialect indicators: rolling means are null until the window is full,
the simple RSI uses plain rolling means, Bollinger uses the sample deviation.
All columns of one call share a single window specification, so the physical
plan is one Exchange on the instrument key, one Sort and one Window operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.windows import DEFAULT, TIME, PanelSpec, add_rolling, col, div


def returns(df: DataFrame, price: str = "close", periods=(1, 5, 10, 20),
            spec: PanelSpec = DEFAULT, log: bool = True) -> DataFrame:
    """``return_{k}d`` = p/p[-k] - 1 and ``log_return_{k}d`` = ln(p/p[-k])."""
    out = {}
    for k in periods:
        ratio = div(price, spec.lag(price, k))
        out[f"return_{k}d"] = ratio - 1
        if log:
            out[f"log_return_{k}d"] = F.when(ratio > 0, F.ln(ratio))
    return df.withColumns(out)


def simple_rsi(close: str, n: int, spec: PanelSpec) -> F.Column:
    """Rolling-mean RSI; the first difference counts as zero gain/loss."""
    d = spec.diff(close)
    gain = F.when(d > 0, d).otherwise(F.lit(0.0))
    loss = F.when(d < 0, -d).otherwise(F.lit(0.0))
    g = spec.mean(gain, n)
    lo = spec.mean(loss, n)
    return (F.when(lo == 0, F.when(g > 0, F.lit(100.0)))
            .otherwise(100.0 - 100.0 / (1.0 + g / lo)))


def technical_basic(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """R3, R4, R5, R7 (R6 MACD is recursive: see recursive.ewm_macd)."""
    stats = {f"ma_{n}": ("avg", "close", n) for n in (5, 10, 20, 50)}
    stats["_bbsd"] = ("stddev_samp", "close", 20)
    if "volume" in df.columns:
        stats["volume_ma_10"] = ("avg", "volume", 10)
    d = spec.diff("close")
    gl = df.withColumns({"_gain": F.when(d > 0, d).otherwise(F.lit(0.0)),
                         "_loss": F.when(d < 0, -d).otherwise(F.lit(0.0))})
    stats.update({"_ag": ("avg", "_gain", 14), "_al": ("avg", "_loss", 14)})
    out = add_rolling(gl, spec, stats)
    g, lo = F.col("_ag"), F.col("_al")
    rsi = F.when(lo == 0, F.when(g > 0, F.lit(100.0))).otherwise(100.0 - 100.0 / (1.0 + g / lo))
    cols = {"rsi": rsi, "bb_middle": F.col("ma_20"),
            "bb_upper": F.col("ma_20") + 2 * F.col("_bbsd"), "bb_lower": F.col("ma_20") - 2 * F.col("_bbsd")}
    if "volume" in df.columns:
        cols["volume_ratio"] = div("volume", "volume_ma_10")
    return out.withColumns(cols).drop("_bbsd", "_gain", "_loss", "_ag", "_al")


def calendar_features(df: DataFrame, c: str = TIME, cyclic: bool = True) -> DataFrame:
    """Calendar parts, period-end flags and sin/cos encodings."""
    d = F.to_date(col(c))
    m = F.month(d)
    wd = F.weekday(d)
    out = {
        "year": F.year(d), "month": m, "day": F.dayofmonth(d), "weekday": wd,
        "quarter": F.quarter(d),
        "is_month_end": d == F.last_day(d),
        "is_quarter_end": (d == F.last_day(d)) & m.isin(3, 6, 9, 12),
        "is_year_end": (d == F.last_day(d)) & (m == 12),
    }
    if cyclic:
        two_pi = 2 * 3.141592653589793
        out.update(month_sin=F.sin(two_pi * m / 12), month_cos=F.cos(two_pi * m / 12),
                   weekday_sin=F.sin(two_pi * wd / 7), weekday_cos=F.cos(two_pi * wd / 7))
    return df.withColumns(out)


def preprocess(df: DataFrame, spec: PanelSpec = DEFAULT, periods=(1, 5, 10, 20)) -> DataFrame:
    """Stages 5-7 of data preparation: returns → indicators → calendar."""
    return calendar_features(technical_basic(returns(df, periods=periods, spec=spec), spec))
