"""Catalog: window-expressible technical indicators."""

from __future__ import annotations

from barlake.operators import technical as T
from barlake.plans.catalog import register
from barlake.plans.common import (W, clean_panel, div_sql, finalize, frame, full_sql, lag_sql,
                                  mean_sql, with_bars)
from barlake.plans.q_features import _bbp, _sql, max_sql, min_sql

KEYS = ["stock_code", "date"]


def _sel(df, cols, overrides=None):
    return finalize(df.select(*KEYS, *cols), overrides=overrides)


def zero_div_sql(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


# -- T1 ------------------------------------------------------------------------------
_sma = {}
for _n in (5, 10, 20, 30, 60):
    _sma[f"sma_{_n}"] = mean_sql("close", _n)
    _sma[f"price_sma_{_n}_ratio"] = div_sql("close", mean_sql("close", _n))


@register("sma_ratio", _sql(_sma), ids="T1")
def q_sma_ratio(spark, d):
    return _sel(T.ma_indicators(clean_panel(spark, d)), list(_sma))


# -- T3 ------------------------------------------------------------------------------
def _wma_sql(n):
    terms = " + ".join([f"close * {float(n)}"] + [f"{lag_sql('close', k)} * {float(n - k)}" for k in range(1, n)])
    return full_sql(n, "close", f"({terms}) / {float(n * (n + 1) / 2)}")


_wma = {f"wma_{n}": _wma_sql(n) for n in (5, 10, 20)}


@register("wma", _sql(_wma), ids="T3")
def q_wma(spark, d):
    return _sel(T.ma_indicators(clean_panel(spark, d)), list(_wma))


# -- T6, T7 --------------------------------------------------------------------------
_mom = {}
for _n in (10, 20):
    _mom[f"momentum_{_n}"] = f"close - {lag_sql('close', _n)}"
    _mom[f"roc_{_n}"] = (f"CASE WHEN {lag_sql('close', _n)} = 0 THEN 0.0 "
                         f"ELSE 100.0 * ({div_sql('close', lag_sql('close', _n))} - 1.0) END")


@register("momentum_roc", _sql(_mom), ids="T6 T7")
def q_momentum_roc(spark, d):
    return _sel(T.momentum_indicators(clean_panel(spark, d)), list(_mom))


# -- T8 ------------------------------------------------------------------------------
_wr = {f"willr_{n}": f"-100.0 * {zero_div_sql(f'{max_sql('high', n)} - close', f'{max_sql('high', n)} - {min_sql('low', n)}')}"
       for n in (14, 21)}


@register("willr", _sql(_wr), ids="T8")
def q_willr(spark, d):
    return _sel(T.momentum_indicators(clean_panel(spark, d)), list(_wr))


# -- T9 ------------------------------------------------------------------------------
_CCI_CTE = ",\ntp0 AS (SELECT *, (high + low + close) / 3.0 AS tp FROM clean)"
_cci_mean = f"avg(tp) OVER {frame(14)}"
_cci_mad = (f"list_reduce(list_transform(list(tp) OVER {frame(14)}, lambda x: abs(x - {_cci_mean})), "
            f"lambda a, b: a + b, 0.0) / 14.0")
_cci = {"cci": full_sql(14, "close", zero_div_sql(f"tp - {_cci_mean}", f"0.015 * {_cci_mad}"))}


@register("cci", _sql(_cci, extra_cte=_CCI_CTE, source="tp0"), ids="T9")
def q_cci(spark, d):
    return _sel(T.momentum_indicators(clean_panel(spark, d)), ["cci"])


# -- T10 -----------------------------------------------------------------------------
_bbm = {**_bbp(20, "_20"), **_bbp(26, "_26")}


@register("bollinger_multi", _sql(_bbm), ids="T10")
def q_bollinger_multi(spark, d):
    return _sel(T.volatility_indicators(clean_panel(spark, d)), list(_bbm))


# -- T12 -----------------------------------------------------------------------------
_tr = {"tr": f"CASE WHEN {lag_sql('close')} IS NOT NULL THEN greatest(high - low, "
             f"abs(high - {lag_sql('close')}), abs(low - {lag_sql('close')})) END"}


@register("true_range", _sql(_tr), ids="T12")
def q_true_range(spark, d):
    return _sel(T.volatility_indicators(clean_panel(spark, d)), ["tr"])


# -- T15 -----------------------------------------------------------------------------
_AR_CTE = f",\nrr AS (SELECT *, row_number() OVER ({W}) AS rn FROM clean)"
_ar_full = f"count(close) OVER {frame(15)} = 15"
_ar = {
    "aroon_down": f"CASE WHEN {_ar_full} THEN 100.0 * (14 - (rn - arg_min(rn, {{'v': low, 'r': -rn}}) OVER {frame(15)})) / 14 END",
    "aroon_up": f"CASE WHEN {_ar_full} THEN 100.0 * (14 - (rn - arg_max(rn, {{'v': high, 'r': rn}}) OVER {frame(15)})) / 14 END",
}
_ar["aroon_oscillator"] = f"({_ar['aroon_up']}) - ({_ar['aroon_down']})"


@register("aroon", _sql(_ar, extra_cte=_AR_CTE, source="rr"), ids="T15")
def q_aroon(spark, d):
    return _sel(T.aroon(clean_panel(spark, d)), list(_ar))


# -- T17-T20 -------------------------------------------------------------------------
_vs = {}
for _n in (5, 10, 20):
    _vs[f"volume_sma_{_n}"] = mean_sql("volume", _n)
    _vs[f"volume_ratio_{_n}"] = div_sql("volume", mean_sql("volume", _n))


@register("volume_sma", _sql(_vs), ids="T17 N5")
def q_volume_sma(spark, d):
    return _sel(T.volume_indicators(clean_panel(spark, d)), list(_vs))


_MFI_CTE = f""",
m0 AS (SELECT *, (high + low + close) / 3.0 AS tp, row_number() OVER ({W}) AS rn FROM clean),
m1 AS (SELECT *, tp * volume AS flow, lag(tp) OVER ({W}) AS ptp FROM m0),
m2 AS (SELECT *, sum(CASE WHEN tp > ptp THEN flow ELSE 0.0 END) OVER {frame(14)} AS pos,
                 sum(CASE WHEN tp < ptp THEN flow ELSE 0.0 END) OVER {frame(14)} AS neg FROM m1)"""


@register("mfi", _sql({"mfi": "CASE WHEN rn > 14 THEN CASE WHEN pos + neg < 1.0 THEN 0.0 "
                               "ELSE 100.0 * pos / (pos + neg) END END"},
                      extra_cte=_MFI_CTE, source="m2"), ids="T18")
def q_mfi(spark, d):
    return _sel(T.volume_indicators(clean_panel(spark, d)), ["mfi"])


_CUM = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_ov = {"obv": f"sum(CASE WHEN {lag_sql('close')} IS NULL THEN volume "
              f"ELSE sign(close - {lag_sql('close')}) * volume END) OVER {_CUM}",
       "vwap": div_sql(f"sum(volume * close) OVER {_CUM}", f"sum(volume) OVER {_CUM}")}
_OV_CTE = f",\no0 AS (SELECT *, CASE WHEN {lag_sql('close')} IS NULL THEN volume ELSE sign(close - {lag_sql('close')}) * volume END AS sv FROM clean)"


@register("obv_vwap", _sql({"obv": f"sum(sv) OVER {_CUM}", "vwap": _ov["vwap"]},
                           extra_cte=_OV_CTE, source="o0", digits={"obv": 4, "vwap": 4}), ids="T19 T20")
def q_obv_vwap(spark, d):
    return _sel(T.volume_indicators(clean_panel(spark, d)), ["obv", "vwap"], {"obv": 4, "vwap": 4})


# -- T21-T23 -------------------------------------------------------------------------
_pt = {"medprice": "(high + low) / 2.0", "typprice": "(high + low + close) / 3.0",
       "wclprice": "(high + low + 2.0 * close) / 4.0"}


@register("price_transforms", _sql(_pt), ids="T21 T22 T23")
def q_price_transforms(spark, d):
    return _sel(T.price_transforms(clean_panel(spark, d)), list(_pt))


# -- T26-T28 -------------------------------------------------------------------------
def _prior(n):
    return f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


_CDL_CTE = f""",
c0 AS (SELECT *, abs(close - open) AS body, high - low AS rng, high - greatest(open, close) AS upper_s,
              least(open, close) - low AS lower_s, row_number() OVER ({W}) AS rn FROM clean),
c1 AS (SELECT *, avg(rng) OVER {_prior(10)} AS ar10, avg(body) OVER {_prior(10)} AS ab10,
              count(rng) OVER {_prior(10)} AS n10, 0.2 * avg(rng) OVER {_prior(5)} AS near,
              lag(low) OVER ({W}) AS plow, lag(high) OVER ({W}) AS phigh FROM c0),
c2 AS (SELECT *, body < ab10 AND lower_s > body AND upper_s < 0.1 * ar10 AS shape FROM c1)"""

_CDL_SQL = with_bars() + _CDL_CTE + """
SELECT stock_code, date,
  CASE WHEN n10 = 10 THEN CASE WHEN body <= 0.1 * ar10 THEN 100 ELSE 0 END END AS doji,
  CASE WHEN rn > 11 THEN CASE WHEN shape AND least(open, close) <= plow + near THEN 100 ELSE 0 END END AS hammer,
  CASE WHEN rn > 11 THEN CASE WHEN shape AND least(open, close) >= phigh - near THEN -100 ELSE 0 END END AS hanging_man
FROM c2"""


@register("candles", _CDL_SQL, ids="T26 T27 T28")
def q_candles(spark, d):
    return _sel(T.candle_patterns(clean_panel(spark, d)), ["doji", "hammer", "hanging_man"])


# -- T29/T30 -------------------------------------------------------------------------
@register("all_indicators", None, check="ROWS", ids="T29 T30")
def q_all_indicators(spark, d):
    out = T.all_indicators(clean_panel(spark, d))
    return finalize(out.select(*KEYS, *T.indicator_names()), overrides={"obv": 4, "vwap": 4})



# -- skew-safe execution of the same library (plans.blocked) ----------------------
@register("blocked_indicators", _sql({**_sma, **_wr, "obv": f"sum(sv) OVER {_CUM}"}, extra_cte=_OV_CTE,
                                     source="o0", digits={"obv": 4}), ids="T1 T8 T19 (blocked, halo)")
def q_blocked(spark, d):
    from barlake.plans.blocked import blocked_window_indicators
    out = blocked_window_indicators(clean_panel(spark, d), block_rows=500, lookback=64)
    return _sel(out, [*_sma, *_wr, "obv"], {"obv": 4})
