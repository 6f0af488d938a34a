"""Catalog: returns, basic indicators, calendar and engineered features (R*, F*)."""

from __future__ import annotations

from barlake.operators import basic as B
from barlake.operators import engineered as E
from barlake.plans.catalog import register
from barlake.plans.common import (clean_panel, div_sql, finalize, frame, full_sql, lag_sql,
                                  mean_sql, rnd_expr, with_bars)

KEYS = ["stock_code", "date"]


def _sel(df, cols):
    return finalize(df.select(*KEYS, *cols))


def _sql(defs: dict, panel: str = "events", digits: dict | None = None, extra_cte: str = "",
         source: str = "clean") -> str:
    """SELECT keys + rounded definitions from the clean panel."""
    digits = digits or {}
    body = ", ".join(f"{expr} AS {name}" for name, expr in defs.items())
    proj = ", ".join(f"{rnd_expr(n, digits.get(n, 6))} AS {n}" for n in defs)
    return (with_bars(panel) + extra_cte +
            f",\nq AS (SELECT stock_code, date, {body} FROM {source})\nSELECT stock_code, date, {proj} FROM q")


def std_sql(c, n):
    return full_sql(n, c, f"stddev_samp({c}) OVER {frame(n)}")


def stdp_sql(c, n):
    return full_sql(n, c, f"stddev_pop({c}) OVER {frame(n)}")


def max_sql(c, n):
    return full_sql(n, c, f"max({c}) OVER {frame(n)}")


def min_sql(c, n):
    return full_sql(n, c, f"min({c}) OVER {frame(n)}")


def pct_sql(c, k):
    return f"{div_sql(c, lag_sql(c, k))} - 1"


# -- R1/R2 ------------------------------------------------------------------------
_ret = {}
for _k in (1, 5, 10, 20):
    _ret[f"return_{_k}d"] = pct_sql("close", _k)
    _ret[f"log_return_{_k}d"] = (f"CASE WHEN {div_sql('close', lag_sql('close', _k))} > 0 "
                                 f"THEN ln({div_sql('close', lag_sql('close', _k))}) END")


@register("returns", _sql(_ret), ids="R1 R2")
def q_returns(spark, d):
    return _sel(B.returns(clean_panel(spark, d)), list(_ret))


# -- R3 moving averages + F9 ----------------------------------------------------------
_ma = {f"ma_{n}": mean_sql("close", n) for n in (5, 10, 20, 50)}


@register("moving_averages", _sql(_ma), ids="R3 F9")
def q_moving_averages(spark, d):
    return _sel(B.technical_basic(clean_panel(spark, d)), list(_ma))


# -- R4 ------------------------------------------------------------------------------------
_RSI_CTE = f""",
dd AS (SELECT *, close - {lag_sql('close')} AS dlt FROM clean),
gl AS (SELECT *, CASE WHEN dlt > 0 THEN dlt ELSE 0.0 END AS g, CASE WHEN dlt < 0 THEN -dlt ELSE 0.0 END AS l FROM dd),
gm AS (SELECT *, {mean_sql('g', 14)} AS ag, {mean_sql('l', 14)} AS al FROM gl)"""


@register("rsi_simple", _sql({"rsi": "CASE WHEN al = 0 THEN CASE WHEN ag > 0 THEN 100.0 END "
                                      "ELSE 100.0 - 100.0 / (1.0 + ag / al) END"},
                             extra_cte=_RSI_CTE, source="gm"), ids="R4")
def q_rsi_simple(spark, d):
    return _sel(B.technical_basic(clean_panel(spark, d)), ["rsi"])


# -- R5 + R7 -----------------------------------------------------------------------------------
_bb = {"bb_middle": mean_sql("close", 20),
       "bb_upper": f"{mean_sql('close', 20)} + 2 * {std_sql('close', 20)}",
       "bb_lower": f"{mean_sql('close', 20)} - 2 * {std_sql('close', 20)}"}


@register("bollinger_sample", _sql(_bb), ids="R5")
def q_bollinger_sample(spark, d):
    return _sel(B.technical_basic(clean_panel(spark, d)), list(_bb))


_vr = {"volume_ma_10": mean_sql("volume", 10),
       "volume_ratio": div_sql("volume", mean_sql("volume", 10))}


@register("volume_ratio", _sql(_vr), ids="R7")
def q_volume_ratio(spark, d):
    return _sel(B.technical_basic(clean_panel(spark, d)), list(_vr))


# -- R8-R10 (daily panel C: month and year ends occur) ---------------------------------------
_CAL_SQL = with_bars("nations") + """
SELECT stock_code, date, year(date) AS year, month(date) AS month, day(date) AS day,
       isodow(date) - 1 AS weekday, quarter(date) AS quarter,
       date = last_day(date) AS is_month_end,
       date = last_day(date) AND month(date) IN (3, 6, 9, 12) AS is_quarter_end,
       date = last_day(date) AND month(date) = 12 AS is_year_end,
""" + ", ".join(f"{rnd_expr(e)} AS {n}" for n, e in (
    ("month_sin", "sin(2 * pi() * month(date) / 12)"), ("month_cos", "cos(2 * pi() * month(date) / 12)"),
    ("weekday_sin", "sin(2 * pi() * (isodow(date) - 1) / 7)"),
    ("weekday_cos", "cos(2 * pi() * (isodow(date) - 1) / 7)"))) + " FROM clean"


@register("calendar_features", _CAL_SQL, ids="R8 R9 R10")
def q_calendar(spark, d):
    out = B.calendar_features(clean_panel(spark, d, "nations"))
    return finalize(out.select(*KEYS, "year", "month", "day", "weekday", "quarter", "is_month_end",
                               "is_quarter_end", "is_year_end", "month_sin", "month_cos",
                               "weekday_sin", "weekday_cos"))


# -- F1, F2, F4 -------------------------------------------------------------------------------------
_pf = {}
for _n in (1, 3, 5, 10, 20):
    _pf[f"return_{_n}d"] = pct_sql("close", _n)
    _pf[f"high_low_ratio_{_n}d"] = full_sql(_n, "hl", f"avg(hl) OVER {frame(_n)}")
_pf["amplitude"] = div_sql("high - low", "close")


@register("price_features", _sql(_pf, extra_cte=",\nc2 AS (SELECT *, high / nullif(low, 0) AS hl FROM clean)",
                                 source="c2"), ids="F1 F2 F4")
def q_price_features(spark, d):
    return _sel(E.price_features(clean_panel(spark, d)), list(_pf))


# -- F3 ---------------------------------------------------------------------------------------------
def _pp_sql(n):
    lst = f"list(close) OVER {frame(n)}"
    less = f"len(list_filter({lst}, lambda x: x < close))"
    eq = f"len(list_filter({lst}, lambda x: x = close))"
    return full_sql(n, "close", f"({less} + ({eq} + 1) / 2.0) / {float(n)}")


_pp = {f"price_position_{n}d": _pp_sql(n) for n in (10, 20, 50)}


@register("price_position", _sql(_pp), ids="F3")
def q_price_position(spark, d):
    return _sel(E.price_features(clean_panel(spark, d)), list(_pp))


# -- F5, F6, F8 --------------------------------------------------------------------------------------
_vf = {}
for _n in (1, 3, 5, 10):
    _vf[f"volume_change_{_n}d"] = pct_sql("volume", _n)
    _vf[f"volume_ma_{_n}d"] = mean_sql("volume", _n)
_vf["money_flow"] = "volume * close"


@register("volume_features", _sql(_vf, digits={"money_flow": 4}), ids="F5 F6 F8")
def q_volume_features(spark, d):
    return finalize(E.volume_features(clean_panel(spark, d)).select(*KEYS, *_vf),
                    overrides={"money_flow": 4})


# -- F7 ------------------------------------------------------------------------------------------------
_corr = {"volume_price_corr": full_sql(
    20, "close", f"covar_pop(volume, close) OVER {frame(20)} / "
                 f"nullif(stddev_pop(volume) OVER {frame(20)} * stddev_pop(close) OVER {frame(20)}, 0)")}


@register("volume_price_corr", _sql(_corr), ids="F7")
def q_volume_price_corr(spark, d):
    return _sel(E.volume_features(clean_panel(spark, d)), list(_corr))


# -- F13 --------------------------------------------------------------------------------------------------
def _bbp(n, suffix=""):
    mid, sd = mean_sql("close", n), stdp_sql("close", n)
    up, lo = f"({mid} + 2 * {sd})", f"({mid} - 2 * {sd})"
    out = {f"bb_upper{suffix}": up, f"bb_middle{suffix}": mid, f"bb_lower{suffix}": lo,
           f"bb_position{suffix}": div_sql(f"close - {lo}", f"{up} - {lo}")}
    if suffix:
        out[f"bb_width{suffix}"] = div_sql(f"{up} - {lo}", mid)
    return out


_bbpop = _bbp(20)


@register("bollinger_pop", _sql(_bbpop), ids="F13")
def q_bollinger_pop(spark, d):
    return _sel(E.bollinger_pop(clean_panel(spark, d)), list(_bbpop))


# -- F14 ---------------------------------------------------------------------------------------------------
_KDJ_CTE = f""",
k0 AS (SELECT *, CASE WHEN count(close) OVER {frame(9)} = 9 THEN
          100.0 * CASE WHEN max(high) OVER {frame(9)} - min(low) OVER {frame(9)} = 0 THEN 0.0
          ELSE (close - min(low) OVER {frame(9)}) / (max(high) OVER {frame(9)} - min(low) OVER {frame(9)}) END
        END AS k_raw FROM clean),
k1 AS (SELECT *, {mean_sql('k_raw', 3)} AS kk FROM k0),
k2 AS (SELECT *, {mean_sql('kk', 3)} AS dd FROM k1)"""


@register("kdj", _sql({"k": "CASE WHEN dd IS NOT NULL THEN kk END", "d": "dd",
                       "j": "3 * CASE WHEN dd IS NOT NULL THEN kk END - 2 * dd"},
                      extra_cte=_KDJ_CTE, source="k2"), ids="F14")
def q_kdj(spark, d):
    return _sel(E.kdj(clean_panel(spark, d)), ["k", "d", "j"])


# -- F15, F16 -----------------------------------------------------------------------------------------------
_lag = {f"close_lag_{k}": lag_sql("close", k) for k in (1, 2, 3, 5, 10)}
_roll = {}
for _n in (5, 10, 20):
    _roll[f"close_mean_{_n}"] = mean_sql("close", _n)
    _roll[f"close_std_{_n}"] = std_sql("close", _n)
    _roll[f"close_max_{_n}"] = max_sql("close", _n)
    _roll[f"close_min_{_n}"] = min_sql("close", _n)


@register("lag_features", _sql(_lag), ids="F15")
def q_lag_features(spark, d):
    return _sel(E.lag_features(clean_panel(spark, d)), list(_lag))


@register("rolling_stats", _sql(_roll), ids="F16")
def q_rolling_stats(spark, d):
    return _sel(E.lag_features(clean_panel(spark, d)), list(_roll))


_lagmany = {f"{c}_lag{k}": lag_sql(c, k) for c in ("close", "volume", "high") for k in (1, 2, 3)}


@register("lag_columns", _sql(_lagmany), ids="N4")
def q_lag_columns(spark, d):
    return _sel(E.lag_columns(clean_panel(spark, d), ["close", "volume", "high"]), list(_lagmany))


# -- F17 ---------------------------------------------------------------------------------------------------------
@register("time_features", with_bars("nations") + """
SELECT stock_code, date, year(date) AS year, month(date) AS month, day(date) AS day,
       isodow(date) - 1 AS weekday, quarter(date) AS quarter,
       day(date) = 1 AS is_month_start, date = last_day(date) AS is_month_end,
       day(date) = 1 AND month(date) IN (1, 4, 7, 10) AS is_quarter_start,
       date = last_day(date) AND month(date) IN (3, 6, 9, 12) AS is_quarter_end
FROM clean""", ids="F17")
def q_time_features(spark, d):
    out = E.time_features(clean_panel(spark, d, "nations"))
    return finalize(out.select(*KEYS, "year", "month", "day", "weekday", "quarter", "is_month_start",
                               "is_month_end", "is_quarter_start", "is_quarter_end"))


# -- F18: composite (window part; recursive part is checked in q_recursive) ----------------------------------------
def _engineered_sql() -> str:
    from barlake.plans.q_recursive import _EWM_CTE, _head, ema_cte, rsi_cte
    win = {**_pf, **_pp, **_vf, **_corr, **{f"sma_{n}": mean_sql("close", n) for n in (5, 10, 20, 50)},
           **_bbpop, **_lag, **_roll}
    time_cols = {"year": "year(date)", "month": "month(date)", "day": "day(date)", "weekday": "isodow(date) - 1",
                 "quarter": "quarter(date)", "is_month_start": "day(date) = 1",
                 "is_month_end": "CAST(date AS DATE) = last_day(date)",
                 "is_quarter_start": "day(date) = 1 AND month(date) IN (1, 4, 7, 10)",
                 "is_quarter_end": "CAST(date AS DATE) = last_day(date) AND month(date) IN (3, 6, 9, 12)"}
    rec = "".join(ema_cte(f"e{n}", "src", "close", n) + f",\ne{n}_o AS (SELECT stock_code, rn, e AS ema_{n} FROM e{n})"
                  for n in (5, 10, 20, 50)) + _EWM_CTE + rsi_cte(14)
    body = f"""{_head()}{rec}{_KDJ_CTE},
c2 AS (SELECT *, high / nullif(low, 0) AS hl FROM clean),
wf AS (SELECT stock_code, date, {", ".join(f"{e} AS {n}" for n, e in win.items())},
              {", ".join(f"{e} AS {n}" for n, e in time_cols.items())} FROM c2),
kd AS (SELECT stock_code, date, CASE WHEN dd IS NOT NULL THEN kk END AS k, dd AS d,
              3 * CASE WHEN dd IS NOT NULL THEN kk END - 2 * dd AS j FROM k2)
SELECT wf.stock_code, wf.date, {", ".join(f"{rnd_expr('wf.' + n)} AS {n}" for n in win)},
       {", ".join(f"wf.{n}" for n in time_cols)},
       {", ".join(f"{rnd_expr('kd.' + n)} AS {n}" for n in ("k", "d", "j"))},
       {", ".join(f"{rnd_expr(f'e{n}_o.ema_{n}')} AS ema_{n}" for n in (5, 10, 20, 50))},
       {rnd_expr('wo.macd')} AS macd, {rnd_expr('wo.macd_signal')} AS macd_signal,
       {rnd_expr('wo.macd_histogram')} AS macd_histogram, {rnd_expr('r14_o.rsi_14')} AS rsi
FROM wf JOIN kd USING (stock_code, date) JOIN src USING (stock_code, date)
{" ".join(f"LEFT JOIN e{n}_o ON e{n}_o.stock_code = src.stock_code AND e{n}_o.rn = src.rn" for n in (5, 10, 20, 50))}
LEFT JOIN wo ON wo.stock_code = src.stock_code AND wo.rn = src.rn
LEFT JOIN r14_o ON r14_o.stock_code = src.stock_code AND r14_o.rn = src.rn"""
    return body


@register("engineered_features", _engineered_sql(), check="REC", ids="F18 (composite: windows + recursions)")
def q_engineered(spark, d):
    out, names = E.engineer_features(clean_panel(spark, d))
    return finalize(out.select(*KEYS, *names))


_PRE_DEFS = {**_ret, **_ma, **_bb, **_vr}
_PRE_CAL = {"year": "year(date)", "month": "month(date)", "day": "day(date)", "weekday": "isodow(date) - 1",
            "quarter": "quarter(date)", "is_month_end": "CAST(date AS DATE) = last_day(date)",
            "is_quarter_end": "CAST(date AS DATE) = last_day(date) AND month(date) IN (3, 6, 9, 12)",
            "is_year_end": "CAST(date AS DATE) = last_day(date) AND month(date) = 12"}
_PRE_CYC = {"month_sin": "sin(2 * pi() * month(date) / 12)", "month_cos": "cos(2 * pi() * month(date) / 12)",
            "weekday_sin": "sin(2 * pi() * (isodow(date) - 1) / 7)",
            "weekday_cos": "cos(2 * pi() * (isodow(date) - 1) / 7)"}
_PRE_SQL = (with_bars() + _RSI_CTE + f""",
pre AS (SELECT stock_code, date, open, high, low, close, volume, amount,
               {", ".join(f"{e} AS {n}" for n, e in _PRE_DEFS.items())},
               CASE WHEN al = 0 THEN CASE WHEN ag > 0 THEN 100.0 END ELSE 100.0 - 100.0 / (1.0 + ag / al) END AS rsi,
               {", ".join(f"{e} AS {n}" for n, e in _PRE_CAL.items())},
               {", ".join(f"{e} AS {n}" for n, e in _PRE_CYC.items())} FROM gm)
SELECT stock_code, date, {", ".join(f"{rnd_expr(c)} AS {c}" for c in ["open", "high", "low", "close", "volume"])},
       {rnd_expr("amount", 4)} AS amount,
       {", ".join(f"{rnd_expr(c)} AS {c}" for c in [*_PRE_DEFS, "rsi", *_PRE_CYC])},
       {", ".join(_PRE_CAL)} FROM pre""")


@register("preprocess_panel", _PRE_SQL, ids="R1-R10 (stages 5-7 composed)")
def q_preprocess(spark, d):
    return finalize(B.preprocess(clean_panel(spark, d)), overrides={"amount": 4})

