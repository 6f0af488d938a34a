"""Catalog: cleaning, gap grid, fills, outliers and scaling."""

from __future__ import annotations

from barlake.operators import clean as C
from barlake.plans.catalog import register
from barlake.plans.common import VALID_SQL, finalize, rnd, rnd_expr, with_bars
from barlake.sources.panels import gap_grid, load_panel

OHLC = ["open", "high", "low", "close"]
GAP_COLS = ["open", "high", "low", "close", "volume", "amount"]


def gapped(spark, d):
    return gap_grid(C.clean_bars(load_panel(spark, d), dedupe=False), "1 hour")


GRID_SQL = with_bars() + """,
span AS (SELECT stock_code, min(date) AS lo, max(date) AS hi FROM clean GROUP BY 1),
grid AS (SELECT stock_code, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS date FROM span),
gap AS (SELECT g.stock_code, g.date, c.open, c.high, c.low, c.close, c.volume, c.amount
        FROM grid g LEFT JOIN clean c USING (stock_code, date))"""

SP = "PARTITION BY stock_code ORDER BY date"


@register("clean_bars", with_bars(clean=False) + f"""
SELECT DISTINCT stock_code, date, {rnd(['open', 'high', 'low', 'close', 'volume'])}, {rnd(['amount'], 4)}
FROM bars WHERE {VALID_SQL}""", ids="P1 P3 P4 P5 P6")
def q_clean_bars(spark, d):
    return finalize(C.clean_bars(load_panel(spark, d)), overrides={"amount": 4})


@register("missing_bars", GRID_SQL + """
SELECT stock_code, date FROM grid ANTI JOIN clean USING (stock_code, date)""", ids="B2 J4")
def q_missing_bars(spark, d):
    bars = C.clean_bars(load_panel(spark, d), dedupe=False)
    grid = gap_grid(bars, "1 hour").select("stock_code", "date")
    return grid.join(bars, ["stock_code", "date"], "left_anti")


@register("null_census", GRID_SQL + """
SELECT column_name AS "column", nulls FROM (
  SELECT count(*) FILTER (WHERE stock_code IS NULL) AS stock_code,
         count(*) FILTER (WHERE date IS NULL) AS date,
         count(*) FILTER (WHERE open IS NULL) AS open,
         count(*) FILTER (WHERE high IS NULL) AS high,
         count(*) FILTER (WHERE low IS NULL) AS low,
         count(*) FILTER (WHERE close IS NULL) AS close,
         count(*) FILTER (WHERE volume IS NULL) AS volume,
         count(*) FILTER (WHERE amount IS NULL) AS amount FROM gap)
UNPIVOT (nulls FOR column_name IN (stock_code, date, open, high, low, close, volume, amount))""",
          ids="P7")
def q_null_census(spark, d):
    return C.null_census(gapped(spark, d))


@register("ffill", GRID_SQL + f""",
f AS (SELECT stock_code, date, {", ".join(
    f"last_value({c} IGNORE NULLS) OVER ({SP} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
    for c in GAP_COLS)} FROM gap)
SELECT stock_code, date, {rnd(GAP_COLS[:5])}, {rnd(['amount'], 4)} FROM f""", ids="P8")
def q_ffill(spark, d):
    return finalize(C.forward_fill(gapped(spark, d), GAP_COLS), overrides={"amount": 4})


@register("bfill", GRID_SQL + f""",
f AS (SELECT stock_code, date, {", ".join(
    f"first_value({c} IGNORE NULLS) OVER ({SP} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}"
    for c in GAP_COLS)} FROM gap)
SELECT stock_code, date, {rnd(GAP_COLS[:5])}, {rnd(['amount'], 4)} FROM f""", ids="P9")
def q_bfill(spark, d):
    return finalize(C.backward_fill(gapped(spark, d), GAP_COLS), overrides={"amount": 4})


def _interp_sql(c):
    pv = (f"last_value(CASE WHEN {c} IS NOT NULL THEN {{'i': rn, 'v': {c}}} END IGNORE NULLS) "
          f"OVER ({SP} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    nx = (f"first_value(CASE WHEN {c} IS NOT NULL THEN {{'i': rn, 'v': {c}}} END IGNORE NULLS) "
          f"OVER ({SP} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    return f"{pv} AS {c}_p, {nx} AS {c}_n"


def _interp_val(c):
    return (f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_p IS NULL THEN NULL "
            f"WHEN {c}_n IS NULL THEN {c}_p.v "
            f"ELSE {c}_p.v + ({c}_n.v - {c}_p.v) * (rn - {c}_p.i) / ({c}_n.i - {c}_p.i) END")


@register("interpolate", GRID_SQL + f""",
r AS (SELECT *, row_number() OVER ({SP}) AS rn FROM gap),
p AS (SELECT *, {", ".join(_interp_sql(c) for c in ['close', 'volume'])} FROM r)
SELECT stock_code, date, {", ".join(f"floor(({_interp_val(c)}) * 1e6 + CAST(0.499755859375 AS DOUBLE)) / 1e6 AS {c}"
                                     for c in ['close', 'volume'])} FROM p""", ids="P10")
def q_interpolate(spark, d):
    g = gapped(spark, d).select("stock_code", "date", "close", "volume")
    return finalize(C.interpolate(g, ["close", "volume"]))


@register("drop_nulls", GRID_SQL + f"""
SELECT stock_code, date, {rnd(GAP_COLS[:5])}, {rnd(['amount'], 4)} FROM gap
WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL
  AND volume IS NOT NULL AND amount IS NOT NULL""", ids="P11")
def q_drop_nulls(spark, d):
    return finalize(C.drop_nulls(gapped(spark, d)), overrides={"amount": 4})


@register("fill_zero", GRID_SQL + f"""
SELECT stock_code, date, {", ".join(f"floor(coalesce({c}, 0) * 1e6 + CAST(0.499755859375 AS DOUBLE)) / 1e6 AS {c}" for c in GAP_COLS[:5])},
       floor(coalesce(amount, 0) * 1e4 + CAST(0.499755859375 AS DOUBLE)) / 1e4 AS amount FROM gap""", ids="P12")
def q_fill_zero(spark, d):
    return finalize(C.fill_zero(gapped(spark, d)), overrides={"amount": 4})


@register("median_impute", GRID_SQL + f""",
m AS (SELECT median(close) AS mc, median(volume) AS mv FROM gap)
SELECT stock_code, date, {rnd_expr('coalesce(close, mc)')} AS close,
       {rnd_expr('coalesce(volume, mv)')} AS volume
FROM gap, m""", ids="P13")
def q_median_impute(spark, d):
    g = gapped(spark, d).select("stock_code", "date", "close", "volume")
    return finalize(C.median_impute(g, ["close", "volume"]))


@register("iqr_outliers", with_bars() + """,
q AS (SELECT quantile_cont(close, [0.25, 0.75]) AS qc, quantile_cont(volume, [0.25, 0.75]) AS qv,
             quantile_cont(amount, [0.25, 0.75]) AS qa FROM clean)
SELECT stock_code, date,
  coalesce(close < qc[1] - 1.5 * (qc[2] - qc[1]) OR close > qc[2] + 1.5 * (qc[2] - qc[1]), false) AS close_outlier,
  coalesce(volume < qv[1] - 1.5 * (qv[2] - qv[1]) OR volume > qv[2] + 1.5 * (qv[2] - qv[1]), false) AS volume_outlier,
  coalesce(amount < qa[1] - 1.5 * (qa[2] - qa[1]) OR amount > qa[2] + 1.5 * (qa[2] - qa[1]), false) AS amount_outlier
FROM clean, q""", ids="P14")
def q_iqr(spark, d):
    bars = C.clean_bars(load_panel(spark, d), dedupe=False)
    cols = ["close", "volume", "amount"]
    return C.iqr_outliers(bars, cols).select("stock_code", "date", *[f"{c}_outlier" for c in cols])


@register("zscore_outliers", GRID_SQL + """,
s AS (SELECT avg(close) AS mc, stddev_pop(close) AS sc, avg(volume) AS mv, stddev_pop(volume) AS sv FROM gap)
SELECT stock_code, date,
  coalesce(abs(close - mc) / nullif(sc, 0) > 3.0, false) AS close_outlier,
  coalesce(abs(volume - mv) / nullif(sv, 0) > 3.0, false) AS volume_outlier
FROM gap, s""", ids="P15")
def q_zscore(spark, d):
    cols = ["close", "volume"]
    return C.zscore_outliers(gapped(spark, d), cols).select(
        "stock_code", "date", *[f"{c}_outlier" for c in cols])


@register("outlier_counts", with_bars() + """,
q AS (SELECT quantile_cont(close, [0.25, 0.75]) AS qc, quantile_cont(volume, [0.25, 0.75]) AS qv FROM clean),
f AS (SELECT coalesce(close < qc[1] - 1.5 * (qc[2] - qc[1]) OR close > qc[2] + 1.5 * (qc[2] - qc[1]), false) AS co,
             coalesce(volume < qv[1] - 1.5 * (qv[2] - qv[1]) OR volume > qv[2] + 1.5 * (qv[2] - qv[1]), false) AS vo
      FROM clean, q)
SELECT 'close' AS "column", count(*) FILTER (WHERE co) AS outliers FROM f
UNION ALL SELECT 'volume', count(*) FILTER (WHERE vo) FROM f""", ids="P16")
def q_outlier_counts(spark, d):
    bars = C.clean_bars(load_panel(spark, d), dedupe=False)
    return C.outlier_counts(C.iqr_outliers(bars, ["close", "volume"]), ["close", "volume"])


@register("scale_standard", with_bars() + f""",
s AS (SELECT avg(close) AS mc, stddev_pop(close) AS sc, avg(volume) AS mv, stddev_pop(volume) AS sv FROM clean)
SELECT stock_code, date,
  floor(((close - mc) / CASE WHEN sc = 0 OR sc IS NULL THEN 1 ELSE sc END) * 1e6 + CAST(0.499755859375 AS DOUBLE)) / 1e6 AS close,
  floor(((volume - mv) / CASE WHEN sv = 0 OR sv IS NULL THEN 1 ELSE sv END) * 1e6 + CAST(0.499755859375 AS DOUBLE)) / 1e6 AS volume
FROM clean, s""", ids="P17")
def q_scale_standard(spark, d):
    bars = C.clean_bars(load_panel(spark, d), dedupe=False).select("stock_code", "date", "close", "volume")
    return finalize(C.standard_scale(bars, ["close", "volume"]))


@register("scale_minmax", with_bars() + """,
s AS (SELECT min(close) AS lc, max(close) AS hc, min(volume) AS lv, max(volume) AS hv FROM clean)
SELECT stock_code, date,
  floor((CASE WHEN hc = lc THEN 0.0 ELSE (close - lc) / (hc - lc) END) * 1e6 + CAST(0.499755859375 AS DOUBLE)) / 1e6 AS close,
  floor((CASE WHEN hv = lv THEN 0.0 ELSE (volume - lv) / (hv - lv) END) * 1e6 + CAST(0.499755859375 AS DOUBLE)) / 1e6 AS volume
FROM clean, s""", ids="P18")
def q_scale_minmax(spark, d):
    bars = C.clean_bars(load_panel(spark, d), dedupe=False).select("stock_code", "date", "close", "volume")
    return finalize(C.minmax_scale(bars, ["close", "volume"]))


@register("null_rate_columns", GRID_SQL + """
SELECT column_name AS "column", floor(share * 1e6 + CAST(0.499755859375 AS DOUBLE)) / 1e6 AS null_share, share > 0.02 AS dropped
FROM (SELECT avg(CASE WHEN open IS NULL THEN 1.0 ELSE 0.0 END) AS open,
             avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) AS close,
             avg(CASE WHEN stock_code IS NULL THEN 1.0 ELSE 0.0 END) AS stock_code FROM gap)
UNPIVOT (share FOR column_name IN (open, close, stock_code))""", ids="N2")
def q_null_rate(spark, d):
    return finalize(C.null_rate_columns(gapped(spark, d), 0.02, ["open", "close", "stock_code"]))
