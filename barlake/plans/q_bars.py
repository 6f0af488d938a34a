"""Catalog: bar building, validation, latest rows and the flagship ranking."""

from __future__ import annotations

from barlake.functions.windows import DEFAULT as S
from barlake.operators import ranking
from barlake.operators.engineered import kdj
from barlake.plans.catalog import register
from barlake.plans.common import (BAR_SQL, clean_panel, div_sql, finalize, frame, lag_sql,
                                  mean_sql, rnd, with_bars)
from barlake.sources.panels import load_panel

BAR_DOUBLES = ["open", "high", "low", "close", "volume", "amount"]


def _bars_query(panel):
    def build(spark, d):
        return finalize(load_panel(spark, d, panel), overrides={"amount": 4, "volume": 4})
    return build


def _bars_sql(panel):
    return (f"SELECT stock_code, date, {rnd(BAR_DOUBLES[:4])}, {rnd(['volume', 'amount'], 4)} "
            f"FROM ({BAR_SQL[panel]})")


for _p, _ids in (("events", "B1 panel A"), ("brands", "B1 panel B"),
                 ("nations", "B1 panel C"), ("suppliers", "B1 panel D")):
    register(f"bars_{_p}", _bars_sql(_p), ids=_ids)(_bars_query(_p))


def flagship(spark, d, n: int = 3):
    """events → hourly bars → clean → return_1d, sma_5, KDJ → newest bar per
    instrument → top/bottom n by the latest one-bar return."""
    bars = clean_panel(spark, d)
    feats = kdj(bars.withColumns({"return_1d": S.pct_change("close", 1),
                                  "sma_5": S.mean("close", 5)}), S)
    latest = ranking.latest_rows(feats.select("stock_code", "date", "close", "return_1d",
                                              "sma_5", "k", "d", "j"))
    ranked = ranking.top_bottom(latest, n, score="return_1d")
    return finalize(ranked)


FLAGSHIP_SQL = with_bars() + f""",
f0 AS (SELECT *, {div_sql('close', lag_sql('close'))} - 1 AS return_1d,
              {mean_sql('close', 5)} AS sma_5,
              100.0 * CASE WHEN max(high) OVER {frame(9)} - min(low) OVER {frame(9)} = 0 THEN 0.0
                  ELSE (close - min(low) OVER {frame(9)}) / (max(high) OVER {frame(9)} - min(low) OVER {frame(9)}) END
                  * CASE WHEN count(close) OVER {frame(9)} = 9 THEN 1 END AS k_raw
       FROM clean),
f1 AS (SELECT *, {mean_sql('k_raw', 3)} AS k0 FROM f0),
f2 AS (SELECT *, {mean_sql('k0', 3)} AS d FROM f1),
f3 AS (SELECT stock_code, date, close, return_1d, sma_5,
              CASE WHEN d IS NOT NULL THEN k0 END AS k, d,
              3 * CASE WHEN d IS NOT NULL THEN k0 END - 2 * d AS j FROM f2),
latest AS (SELECT * FROM f3 QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY date DESC) = 1),
top AS (SELECT *, row_number() OVER (ORDER BY return_1d DESC NULLS LAST, stock_code) AS rank,
               'top_gainers' AS category
        FROM latest ORDER BY return_1d DESC NULLS LAST, stock_code LIMIT 3),
bot AS (SELECT *, row_number() OVER (ORDER BY return_1d, stock_code DESC) AS rank,
               'top_losers' AS category
        FROM latest WHERE return_1d IS NOT NULL ORDER BY return_1d, stock_code DESC LIMIT 3)
SELECT stock_code, date, {rnd(['close', 'return_1d', 'sma_5', 'k', 'd', 'j'])}, rank, category
FROM (SELECT * FROM top UNION ALL SELECT * FROM bot)"""

register("flagship_top_bottom", FLAGSHIP_SQL, ids="B1 P3-P6 R1 F9 F14 M10 Q2")(flagship)


def latest(spark, d):
    bars = clean_panel(spark, d)
    return finalize(ranking.latest_rows(bars), overrides={"amount": 4})


register("latest_rows", with_bars() + f"""
SELECT stock_code, date, {rnd(['open', 'high', 'low', 'close', 'volume'])}, {rnd(['amount'], 4)}
FROM clean QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY date DESC) = 1""",
         ids="M10")(latest)


def validate_report(spark, d):
    """One row: rows, missing required columns, close null share, verdict."""
    from barlake.sources.files import validation_report
    return finalize(validation_report(load_panel(spark, d)))


register("validate_report", with_bars(clean=False) + f"""
SELECT count(*) AS n_rows, '' AS missing_columns,
       {rnd(['close_null_ratio'])},
       count(*) > 0 AND coalesce(close_null_ratio, 1.0) <= 0.5 AS valid
FROM (SELECT *, avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) OVER () AS close_null_ratio FROM bars)
GROUP BY close_null_ratio""", ids="S9")(validate_report)


def dataset_summary(spark, d):
    """K2 + S15: records, instruments, date range, feature count."""
    from barlake.sources.files import dataset_summary as summ
    return finalize(summ(clean_panel(spark, d)))


register("dataset_summary", with_bars() + """
SELECT count(*) AS total_records, count(DISTINCT stock_code) AS unique_stocks,
       min(date) AS start_date, max(date) AS end_date, CAST(6 AS BIGINT) AS feature_count
FROM clean""", ids="K2 S15")(dataset_summary)


def lookback_scan(spark, d):
    """Bars of listed instruments inside a date range, chosen fields."""
    from barlake.sources.files import load_bar_range
    bars = load_panel(spark, d, start="2024-01-05", end="2024-01-20")
    universe = spark.createDataFrame([("click",), ("view",), ("purchase",)], "stock_code string")
    out = load_bar_range(bars, universe, "2024-01-05", "2024-01-20", ["close", "volume"])
    return finalize(out)


register("lookback_scan", with_bars(clean=False) + f"""
SELECT stock_code, date, {rnd(['close', 'volume'])} FROM bars
WHERE stock_code IN ('click', 'view', 'purchase')
  AND CAST(date AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
         ids="S12 S13 S17 J3")(lookback_scan)
