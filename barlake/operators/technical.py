"""Technical indicator library (T1-T30), window-expressible part.

Definitions follow the published formulas (Wilder, Lane, Bollinger, Chande,
Lambert, Williams, Granville) with TA-style warm-up: a value exists only once
its full look-back is available. Recursive members (EMA, TEMA, Wilder RSI,
ATR, seeded MACD, ADX, SAR, Hilbert trend) live in ``recursive``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.windows import DEFAULT, PanelSpec, add_rolling, div, div_or_zero
from barlake.operators.engineered import bollinger_pop


def ma_indicators(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """T1 + T3 (T2 and T4 are recursive)."""
    out = add_rolling(df, spec, {f"sma_{n}": ("avg", "close", n) for n in (5, 10, 20, 30, 60)})
    cols = {f"price_sma_{n}_ratio": div("close", f"sma_{n}") for n in (5, 10, 20, 30, 60)}
    for n in (5, 10, 20):
        cols[f"wma_{n}"] = spec.full(n, "close", spec.wma("close", n))
    return out.withColumns(cols)


def cci(df: DataFrame, spec: PanelSpec, n: int = 14, out: str = "cci") -> DataFrame:
    """(TP - SMA(TP)) / (0.015 · mean absolute deviation); 0 on a flat window."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    fr = spec.trailing(n)
    d = df.withColumns({"_tp": tp, "_tpm": F.avg(tp).over(fr), "_tpl": F.collect_list(tp).over(fr)})
    mad = F.aggregate(F.col("_tpl"), F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_tpm"))) / float(n)
    val = spec.full(n, "close", div_or_zero(F.col("_tp") - F.col("_tpm"), 0.015 * mad))
    return d.withColumn(out, val).drop("_tp", "_tpm", "_tpl")


def momentum_indicators(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """T6-T9 (T5 RSI is recursive)."""
    out = {}
    for n in (10, 20):
        prev = spec.lag("close", n)
        out[f"momentum_{n}"] = F.col("close") - prev
        out[f"roc_{n}"] = F.when(prev == 0, F.lit(0.0)).otherwise(100.0 * (div("close", prev) - 1.0))
    df = add_rolling(df.withColumns(out), spec,
                     {f"_hh{n}": ("max", "high", n) for n in (14, 21)} | {f"_ll{n}": ("min", "low", n) for n in (14, 21)})
    df = df.withColumns({f"willr_{n}": -100.0 * div_or_zero(F.col(f"_hh{n}") - F.col("close"),
                                                            F.col(f"_hh{n}") - F.col(f"_ll{n}"))
                         for n in (14, 21)}).drop(*[f"_hh{n}" for n in (14, 21)], *[f"_ll{n}" for n in (14, 21)])
    return cci(df, spec)


def true_range(spec: PanelSpec = DEFAULT) -> F.Column:
    """max(h-l, |h-c₋₁|, |l-c₋₁|); null on the first bar."""
    pc = spec.lag("close")
    return F.when(pc.isNotNull(), F.greatest(F.col("high") - F.col("low"),
                                             F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))


def volatility_indicators(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """T10 + T12 (T11 ATR is recursive)."""
    out = bollinger_pop(df, 20, spec, suffix="_20")
    out = bollinger_pop(out, 26, spec, suffix="_26")
    return out.withColumn("tr", true_range(spec))


def aroon(df: DataFrame, n: int = 14, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Bars since the n+1-bar extreme; the newest extreme wins ties."""
    rn = "__rn"
    fr = spec.trailing(n + 1)
    out = df.withColumn(rn, spec.row_number())
    hi_at = F.max_by(F.col(rn), F.struct(F.col("high"), F.col(rn))).over(fr)
    lo_at = F.min_by(F.col(rn), F.struct(F.col("low"), -F.col(rn))).over(fr)
    full = F.count("close").over(fr) == n + 1
    up = F.when(full, 100.0 * (n - (F.col(rn) - hi_at)) / n)
    down = F.when(full, 100.0 * (n - (F.col(rn) - lo_at)) / n)
    return (out.withColumns({"aroon_down": down, "aroon_up": up})
            .withColumn("aroon_oscillator", F.col("aroon_up") - F.col("aroon_down")).drop(rn))


def volume_indicators(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """T17-T20."""
    out = add_rolling(df, spec, {f"volume_sma_{n}": ("avg", "volume", n) for n in (5, 10, 20)})
    out = out.withColumns({f"volume_ratio_{n}": div("volume", f"volume_sma_{n}") for n in (5, 10, 20)})
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    ptp = spec.lag(tp)
    flow = tp * F.col("volume")
    out = out.withColumns({"_pos": F.sum(F.when(tp > ptp, flow).otherwise(0.0)).over(spec.trailing(14)),
                           "_neg": F.sum(F.when(tp < ptp, flow).otherwise(0.0)).over(spec.trailing(14)),
                           "_rn": spec.row_number()})
    pos, neg = F.col("_pos"), F.col("_neg")
    cols = {"mfi": F.when(F.col("_rn") > 14, F.when(pos + neg < 1.0, F.lit(0.0)).otherwise(100.0 * pos / (pos + neg)))}
    dc = spec.diff("close")
    signed = F.when(dc.isNull(), F.col("volume")).otherwise(F.signum(dc) * F.col("volume"))
    cols["obv"] = F.sum(signed).over(spec.cumulative())
    cols["vwap"] = div(F.sum(F.col("volume") * F.col("close")).over(spec.cumulative()),
                       F.sum("volume").over(spec.cumulative()))
    return out.withColumns(cols).drop("_pos", "_neg", "_rn")


def price_transforms(df: DataFrame) -> DataFrame:
    """T21-T23."""
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    return df.withColumns({"medprice": (h + lo) / 2.0, "typprice": (h + lo + c) / 3.0,
                           "wclprice": (h + lo + 2.0 * c) / 4.0})


def candle_patterns(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """T26-T28 under the pinned candle contract.

    body = |c - o|; small = body < mean body of the 10 prior bars; long lower
    shadow = lower shadow > body; tiny upper shadow < 10 % of the mean range of
    the 10 prior bars; near = 20 % of the mean range of the 5 bars ending at
    the prior bar.
    """
    o, h, lo, c = F.col("open"), F.col("high"), F.col("low"), F.col("close")
    body = F.abs(c - o)
    rng = h - lo
    prior10 = spec.prior(10, 1)
    d = df.withColumns({"_ar10": F.avg(rng).over(prior10), "_ab10": F.avg(body).over(prior10),
                        "_n10": F.count(rng).over(prior10), "_near": 0.2 * F.avg(rng).over(spec.prior(5, 1)),
                        "_rn": spec.row_number(), "_pl": spec.lag("low"), "_ph": spec.lag("high")})
    upper = h - F.greatest(o, c)
    lower = F.least(o, c) - lo
    ar10 = F.col("_ar10")
    doji = F.when(F.col("_n10") == 10, F.when(body <= 0.1 * ar10, 100).otherwise(0))
    shape = (body < F.col("_ab10")) & (lower > body) & (upper < 0.1 * ar10)
    hammer = F.when(F.col("_rn") > 11, F.when(shape & (F.least(o, c) <= F.col("_pl") + F.col("_near")), 100).otherwise(0))
    hanging = F.when(F.col("_rn") > 11, F.when(shape & (F.least(o, c) >= F.col("_ph") - F.col("_near")), -100).otherwise(0))
    return (d.withColumns({"doji": doji, "hammer": hammer, "hanging_man": hanging})
            .drop("_ar10", "_ab10", "_n10", "_near", "_rn", "_pl", "_ph"))


def window_indicators(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Every window-expressible T column in one pass (same window spec)."""
    out = ma_indicators(df, spec)
    out = momentum_indicators(out, spec)
    out = volatility_indicators(out, spec)
    out = aroon(out, 14, spec)
    out = volume_indicators(out, spec)
    out = price_transforms(out)
    return candle_patterns(out, spec)


def all_indicators(df: DataFrame, spec: PanelSpec = DEFAULT, cycles: bool = True) -> DataFrame:
    """Window indicators, then one grouped map for every recursive column."""
    from barlake.operators import recursive

    kinds = recursive.TECHNICAL + (recursive.CYCLES if cycles else ())
    return recursive.apply_recursive(window_indicators(df, spec), kinds, spec=spec)


# The indicator catalogue (output names of T29), in the order
# the reference lists them.
def indicator_names() -> list[str]:
    """T30."""
    names: list[str] = []
    for p in (5, 10, 20, 30, 60):
        names += [f"sma_{p}", f"price_sma_{p}_ratio"]
    for p in (5, 10, 20, 30):
        names += [f"ema_{p}", f"price_ema_{p}_ratio"]
    names += [f"wma_{p}" for p in (5, 10, 20)] + ["tema"]
    names += [f"rsi_{p}" for p in (6, 12, 24)]
    for p in (10, 20):
        names += [f"momentum_{p}", f"roc_{p}"]
    names += ["willr_14", "willr_21", "cci"]
    for p in (20, 26):
        names += [f"bb_upper_{p}", f"bb_middle_{p}", f"bb_lower_{p}", f"bb_width_{p}",
                  f"bb_position_{p}"]
    names += ["atr_14", "atr_21", "tr"]
    names += ["macd", "macd_signal", "macd_histogram", "adx", "aroon_down", "aroon_up",
              "aroon_oscillator", "sar"]
    for p in (5, 10, 20):
        names += [f"volume_sma_{p}", f"volume_ratio_{p}"]
    names += ["mfi", "obv", "vwap", "medprice", "typprice", "wclprice",
              "ht_trendline", "ht_trendmode", "doji", "hammer", "hanging_man"]
    return names
