"""Catalog: recursive indicators checked against DuckDB recursive CTEs.

The oracle walks each instrument's bars by row number with ``WITH RECURSIVE``; the Spark side
runs :mod:`barlake.operators.scans` over blocks of 200 bars or so, so that each query composes
block maps (or replays blocks) as a long instrument would at the default size.
"""

from __future__ import annotations

from barlake.operators import recursive as R
from barlake.plans.catalog import register
from barlake.plans.common import BAR_SQL, VALID_SQL, W, clean_panel, finalize, rnd_expr

KEYS = ["stock_code", "date"]
BLOCK_ROWS = 200


def _spark(kinds, cols, panel="events"):
    def build(spark, d):
        out = R.apply_recursive(clean_panel(spark, d, panel), kinds, block_rows=BLOCK_ROWS, bucket_seconds=86400)
        return finalize(out.select(*KEYS, *cols))
    return build


def _head(panel="events") -> str:
    return (f"WITH RECURSIVE bars AS ({BAR_SQL[panel]}),\n"
            f"clean AS (SELECT * FROM bars WHERE {VALID_SQL}),\n"
            f"src AS (SELECT stock_code, date, open, high, low, close, volume, "
            f"row_number() OVER ({W}) AS rn FROM clean)")


def ema_cte(name: str, source: str, col: str, n: int, first: int = 1, seed_at: int | None = None) -> str:
    """SMA-seeded EMA over ``source(stock_code, rn, col)``; seed = mean of the n
    values ending at row ``seed_at`` (default first + n - 1)."""
    at = seed_at if seed_at is not None else first + n - 1
    a = 2.0 / (n + 1)
    return f""",
{name}_seed AS (SELECT stock_code, {at} AS rn, avg({col}) AS e FROM {source}
               WHERE rn BETWEEN {at - n + 1} AND {at} GROUP BY stock_code HAVING count({col}) = {n}),
{name} AS (SELECT stock_code, rn, e FROM {name}_seed
           UNION ALL
           SELECT s.stock_code, s.rn, {a!r} * s.{col} + (1 - {a!r}) * r.e
           FROM {name} r JOIN {source} s ON s.stock_code = r.stock_code AND s.rn = r.rn + 1)"""


def _final(select_cols: dict, joins: list[str], extra_cte: str = "", panel="events") -> str:
    proj = ", ".join(f"{rnd_expr(e)} AS {n}" for n, e in select_cols.items())
    j = " ".join(f"LEFT JOIN {t} USING (stock_code, rn)" for t in joins)
    return _head(panel) + extra_cte + f"\nSELECT src.stock_code, src.date, {proj} FROM src {j}"


# -- T2 / F10: seeded EMAs -------------------------------------------------------------------
def _ema_query(periods, ratios):
    cte = "".join(ema_cte(f"e{n}", "src", "close", n) for n in periods)
    cols = {}
    joins = []
    for n in periods:
        cte += f",\ne{n}_o AS (SELECT stock_code, rn, e AS ema_{n} FROM e{n})"
        joins.append(f"e{n}_o")
        cols[f"ema_{n}"] = f"ema_{n}"
        if ratios:
            cols[f"price_ema_{n}_ratio"] = f"close / nullif(ema_{n}, 0)"
    return _final(cols, joins, cte)


register("ema", _ema_query((5, 10, 20, 30), True), check="REC", ids="T2")(
    _spark(("ema_technical",), [c for n in (5, 10, 20, 30) for c in (f"ema_{n}", f"price_ema_{n}_ratio")]))
register("ema_engineered", _ema_query((5, 10, 20, 50), False), check="REC", ids="F10")(
    _spark(("ema_engineered",), [f"ema_{n}" for n in (5, 10, 20, 50)]))


# -- T4 TEMA -------------------------------------------------------------------------------------
_TEMA_CTE = (ema_cte("t1", "src", "close", 30)
             + ",\nt1s AS (SELECT stock_code, rn, e AS x FROM t1)" + ema_cte("t2", "t1s", "x", 30, first=30)
             + ",\nt2s AS (SELECT stock_code, rn, e AS x FROM t2)" + ema_cte("t3", "t2s", "x", 30, first=59)
             + """,
tm AS (SELECT t1.stock_code, t1.rn, 3 * t1.e - 3 * t2.e + t3.e AS tema
       FROM t1 JOIN t2 USING (stock_code, rn) JOIN t3 USING (stock_code, rn))""")
register("tema", _final({"tema": "tema"}, ["tm"], _TEMA_CTE), check="REC", ids="T4")(
    _spark(("tema",), ["tema"]))


# -- F12 / T5: Wilder RSI -------------------------------------------------------------------------
def rsi_cte(n: int) -> str:
    return f""",
g{n} AS (SELECT stock_code, rn, CASE WHEN d > 0 THEN d ELSE 0.0 END AS g, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS l
        FROM (SELECT stock_code, rn, close - lag(close) OVER (PARTITION BY stock_code ORDER BY rn) AS d FROM src)
        WHERE rn > 1),
r{n}_seed AS (SELECT stock_code, {n + 1} AS rn, avg(g) AS ag, avg(l) AS al FROM g{n}
             WHERE rn BETWEEN 2 AND {n + 1} GROUP BY stock_code HAVING count(*) = {n}),
r{n} AS (SELECT stock_code, rn, ag, al FROM r{n}_seed
         UNION ALL
         SELECT s.stock_code, s.rn, (r.ag * {n - 1} + s.g) / {n}, (r.al * {n - 1} + s.l) / {n}
         FROM r{n} r JOIN g{n} s ON s.stock_code = r.stock_code AND s.rn = r.rn + 1),
r{n}_o AS (SELECT stock_code, rn, CASE WHEN abs(ag + al) < 1e-8 THEN 0.0 ELSE 100.0 * ag / (ag + al) END AS rsi_{n}
          FROM r{n})"""


register("rsi_wilder", _final({f"rsi_{n}": f"rsi_{n}" for n in (6, 12, 24)}, [f"r{n}_o" for n in (6, 12, 24)],
                              "".join(rsi_cte(n) for n in (6, 12, 24))), check="REC", ids="T5")(
    _spark(("rsi_multi",), ["rsi_6", "rsi_12", "rsi_24"]))
register("rsi14", _final({"rsi": "rsi_14"}, ["r14_o"], rsi_cte(14)), check="REC", ids="F12")(
    _spark(("rsi14",), ["rsi"]))


# -- T11 ATR -----------------------------------------------------------------------------------------
def atr_cte(n: int) -> str:
    return f""",
tr{n} AS (SELECT stock_code, rn, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
         FROM (SELECT *, lag(close) OVER (PARTITION BY stock_code ORDER BY rn) AS pc FROM src) WHERE rn > 1),
a{n}_seed AS (SELECT stock_code, {n + 1} AS rn, avg(tr) AS a FROM tr{n}
             WHERE rn BETWEEN 2 AND {n + 1} GROUP BY stock_code HAVING count(*) = {n}),
a{n} AS (SELECT stock_code, rn, a FROM a{n}_seed
         UNION ALL
         SELECT s.stock_code, s.rn, (r.a * {n - 1} + s.tr) / {n}
         FROM a{n} r JOIN tr{n} s ON s.stock_code = r.stock_code AND s.rn = r.rn + 1),
a{n}_o AS (SELECT stock_code, rn, a AS atr_{n} FROM a{n})"""


register("atr", _final({"atr_14": "atr_14", "atr_21": "atr_21"}, ["a14_o", "a21_o"],
                       atr_cte(14) + atr_cte(21)), check="REC", ids="T11")(
    _spark(("atr",), ["atr_14", "atr_21"]))


# -- T13 seeded MACD ------------------------------------------------------------------------------------
_MACD_CTE = (ema_cte("ms", "src", "close", 26) + ema_cte("mf", "src", "close", 12, seed_at=26)
             + """,
ml AS (SELECT ms.stock_code, ms.rn, mf.e - ms.e AS x FROM ms JOIN mf USING (stock_code, rn))"""
             + ema_cte("sg", "ml", "x", 9, first=26)
             + """,
mo AS (SELECT ml.stock_code, ml.rn, ml.x AS macd, sg.e AS macd_signal, ml.x - sg.e AS macd_histogram
       FROM ml JOIN sg USING (stock_code, rn) WHERE ml.rn >= 34)""")
register("macd_seeded", _final({"macd": "macd", "macd_signal": "macd_signal",
                                "macd_histogram": "macd_histogram"}, ["mo"], _MACD_CTE),
         check="REC", ids="T13")(_spark(("macd_seeded",), ["macd", "macd_signal", "macd_histogram"]))


# -- R6 / F11 adjusted-EWM MACD ---------------------------------------------------------------------------
def _ewm_cte(name, source, col, span, first=1):
    a = 2.0 / (span + 1)
    return f""",
{name} AS (SELECT stock_code, rn, CAST({col} AS DOUBLE) AS num, CAST(1.0 AS DOUBLE) AS den FROM {source} WHERE rn = {first}
           UNION ALL
           SELECT s.stock_code, s.rn, s.{col} + (1 - {a!r}) * r.num, 1.0 + (1 - {a!r}) * r.den
           FROM {name} r JOIN {source} s ON s.stock_code = r.stock_code AND s.rn = r.rn + 1)"""


_EWM_CTE = (_ewm_cte("w12", "src", "close", 12) + _ewm_cte("w26", "src", "close", 26)
            + """,
wl AS (SELECT w12.stock_code, w12.rn, w12.num / w12.den - w26.num / w26.den AS x
       FROM w12 JOIN w26 USING (stock_code, rn))""" + _ewm_cte("w9", "wl", "x", 9)
            + """,
wo AS (SELECT wl.stock_code, wl.rn, wl.x AS macd, w9.num / w9.den AS macd_signal,
              wl.x - w9.num / w9.den AS macd_histogram FROM wl JOIN w9 USING (stock_code, rn))""")
register("ewm_macd", _final({"macd": "macd", "macd_signal": "macd_signal",
                             "macd_histogram": "macd_histogram"}, ["wo"], _EWM_CTE),
         check="REC", ids="R6 F11")(_spark(("ewm_macd",), ["macd", "macd_signal", "macd_histogram"]))


# -- T14 ADX ---------------------------------------------------------------------------------------------------
def adx_sql(n: int = 14) -> str:
    cte = f""",
dm AS (SELECT stock_code, rn,
              CASE WHEN dn > 0 AND up < dn THEN 0.0 WHEN up > 0 AND up > dn THEN up ELSE 0.0 END AS pdm,
              CASE WHEN dn > 0 AND up < dn THEN dn ELSE 0.0 END AS mdm,
              greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
       FROM (SELECT *, high - lag(high) OVER (PARTITION BY stock_code ORDER BY rn) AS up,
                    lag(low) OVER (PARTITION BY stock_code ORDER BY rn) - low AS dn,
                    lag(close) OVER (PARTITION BY stock_code ORDER BY rn) AS pc FROM src) WHERE rn > 1),
ax AS (SELECT stock_code, rn, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS t,
              CAST(0 AS DOUBLE) AS sdx, CAST(NULL AS DOUBLE) AS adx
       FROM src WHERE rn = 1
       UNION ALL
       SELECT stock_code, rn, np, nm, nt,
              CASE WHEN rn > {n} AND rn <= {2 * n} THEN sdx + coalesce(dx, 0.0) ELSE sdx END,
              CASE WHEN rn = {2 * n} THEN (sdx + coalesce(dx, 0.0)) / {n}
                   WHEN rn > {2 * n} THEN CASE WHEN dx IS NOT NULL THEN (adx * {n - 1} + dx) / {n} ELSE adx END END
       FROM (SELECT q.*, CASE WHEN abs(nt) >= 1e-8 AND abs(100 * nm / nt + 100 * np / nt) >= 1e-8
                              THEN 100 * abs(100 * nm / nt - 100 * np / nt) / (100 * nm / nt + 100 * np / nt) END AS dx
             FROM (SELECT s.stock_code, s.rn, r.sdx, r.adx,
                          CASE WHEN s.rn <= {n} THEN r.p + s.pdm ELSE r.p - r.p / {n} + s.pdm END AS np,
                          CASE WHEN s.rn <= {n} THEN r.m + s.mdm ELSE r.m - r.m / {n} + s.mdm END AS nm,
                          CASE WHEN s.rn <= {n} THEN r.t + s.tr ELSE r.t - r.t / {n} + s.tr END AS nt
                   FROM ax r JOIN dm s ON s.stock_code = r.stock_code AND s.rn = r.rn + 1) q) z),
ao AS (SELECT stock_code, rn, adx FROM ax WHERE rn >= {2 * n})"""
    return _final({"adx": "adx"}, ["ao"], cte)


register("adx", adx_sql(14), check="REC", ids="T14")(_spark(("adx",), ["adx"]))


# -- T16 SAR, T24/T25 Hilbert: rows-only here, fixtures in tests ---------------------------------------------
_IL = "NOT ((a.low - b.low) > 0 AND (b.high - a.high) < (a.low - b.low))"
_SAR_CTE = f""",
init AS (SELECT a.stock_code, {_IL} AS is_long, CAST(0.02 AS DOUBLE) AS af,
                CASE WHEN {_IL} THEN b.high ELSE b.low END AS ep,
                CASE WHEN {_IL} THEN a.low ELSE a.high END AS s, b.low AS nl, b.high AS nh
         FROM src a JOIN src b ON a.stock_code = b.stock_code AND a.rn = 1 AND b.rn = 2),
sr AS (SELECT stock_code, 1 AS rn, is_long, af, ep, s, nl, nh, CAST(NULL AS DOUBLE) AS sar FROM init
       UNION ALL
       SELECT stock_code, rn,
              CASE WHEN sw THEN NOT is_long ELSE is_long END,
              af2, ep2,
              CASE WHEN is_long AND NOT sw THEN least(s + af2 * (ep2 - s), prev_lo, new_lo)
                   WHEN is_long AND sw THEN greatest(s_sw + af2 * (ep2 - s_sw), prev_hi, new_hi)
                   WHEN NOT is_long AND NOT sw THEN greatest(s + af2 * (ep2 - s), prev_hi, new_hi)
                   ELSE least(s_sw + af2 * (ep2 - s_sw), prev_lo, new_lo) END,
              new_lo, new_hi,
              CASE WHEN sw THEN s_sw ELSE s END
       FROM (SELECT x.*,
                    CASE WHEN sw THEN CAST(0.02 AS DOUBLE)
                         WHEN is_long AND new_hi > ep THEN least(af + 0.02, 0.2)
                         WHEN NOT is_long AND new_lo < ep THEN least(af + 0.02, 0.2)
                         ELSE af END AS af2,
                    CASE WHEN sw AND is_long THEN new_lo WHEN sw THEN new_hi
                         WHEN is_long AND new_hi > ep THEN new_hi
                         WHEN NOT is_long AND new_lo < ep THEN new_lo ELSE ep END AS ep2,
                    CASE WHEN is_long THEN greatest(ep, prev_hi, new_hi) ELSE least(ep, prev_lo, new_lo) END AS s_sw
             FROM (SELECT r.stock_code, q.rn, r.is_long, r.af, r.ep, r.s, r.nl AS prev_lo, r.nh AS prev_hi,
                          q.low AS new_lo, q.high AS new_hi,
                          CASE WHEN r.is_long THEN q.low <= r.s ELSE q.high >= r.s END AS sw
                   FROM sr r JOIN src q ON q.stock_code = r.stock_code AND q.rn = r.rn + 1) x) y),
so AS (SELECT stock_code, rn, sar FROM sr)"""
register("sar", _final({"sar": "sar"}, ["so"], _SAR_CTE), check="REC", ids="T16")(_spark(("sar",), ["sar"]))
register("ht_trend", None, check="ROWS", ids="T24 T25")(_spark(("ht",), ["ht_trendline", "ht_trendmode"]))


# -- several kinds in one set of passes ---------------------------------------------
_BLK_CTE = ema_cte("e20", "src", "close", 20) + ",\ne20_o AS (SELECT stock_code, rn, e AS ema_20 FROM e20)" + rsi_cte(12)
register("blocked_ema_rsi", _final({"ema_20": "ema_20", "rsi_12": "rsi_12"}, ["e20_o", "r12_o"], _BLK_CTE),
         check="REC", ids="T2 T5 F10 F12 (together)")(_spark(("ema_technical", "rsi_multi"), ["ema_20", "rsi_12"]))
