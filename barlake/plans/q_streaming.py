"""Catalog: Structured Streaming queries (Z1-Z5, N6), each drained with availableNow.

Every run writes into a fresh sub-folder of the shared checkpoint directory
(sink data + streaming checkpoint) and returns the sink read back as a batch
DataFrame. In append mode only windows closed by the watermark (10 minutes
behind the newest tick) are emitted; the oracles apply the same rule.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barlake.functions.windows import DEFAULT as S
from barlake.operators import models as M
from barlake.operators.splits import next_return_label
from barlake.plans.catalog import register
from barlake.plans.common import BAR_SQL, W, clean_panel, finalize, rnd, rnd_expr, with_bars
from barlake.plans.q_recursive import ema_cte, rsi_cte
from barlake.session import scratch_path
from barlake.streaming import bars as ZB
from barlake.streaming import ordered as ZO

CLOSED = "date + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE value IS NOT NULL) - INTERVAL 10 MINUTE"


def _scratch(spark, name):
    return scratch_path(spark, f"stream/{name}/{uuid.uuid4().hex}")


def _bars_to_folder(spark, d, root):
    ticks = ZB.tick_stream(spark, d, glob="events.parquet")
    ZB.run_to_folder(ZB.stream_bars(ticks), f"{root}/bars", f"{root}/ck_bars")
    return f"{root}/bars"


@register("stream_bars", f"""
WITH b AS ({BAR_SQL['events']})
SELECT stock_code, date, {rnd(['open', 'high', 'low', 'close', 'volume'])}, {rnd(['amount'], 4)}
FROM b WHERE {CLOSED}""", ids="Z1")
def q_stream_bars(spark, d):
    root = _scratch(spark, "bars")
    return finalize(spark.read.parquet(_bars_to_folder(spark, d, root)), overrides={"amount": 4})


@register("stream_late_ticks", f"""
WITH b AS ({BAR_SQL['events'].replace('WHERE value IS NOT NULL', "WHERE ts >= TIMESTAMP '2024-01-15' AND value IS NOT NULL")})
SELECT stock_code, date, {rnd(['close', 'volume'])} FROM b WHERE {CLOSED}""", ids="Z2")
def q_stream_late(spark, d):
    """Newer ticks arrive first, older ones in a second micro-batch: the old
    ones are behind the watermark and are dropped, not merged into bars."""
    root = _scratch(spark, "late")
    ev = spark.read.parquet(f"{d}/events.parquet")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    ev.where(F.col("ts") >= cut).write.mode("append").parquet(f"{root}/in")
    ticks = ZB.tick_stream(spark, f"{root}/in", glob="*.parquet")
    ZB.run_to_folder(ZB.stream_bars(ticks), f"{root}/bars", f"{root}/ck")
    # the older ticks arrive afterwards; the restarted query resumes from its
    # checkpoint (watermark included) and drops them as late
    ev.where(F.col("ts") < cut).write.mode("append").parquet(f"{root}/in")
    ticks = ZB.tick_stream(spark, f"{root}/in", glob="*.parquet")
    ZB.run_to_folder(ZB.stream_bars(ticks), f"{root}/bars", f"{root}/ck")
    return finalize(spark.read.parquet(f"{root}/bars").select("stock_code", "date", "close", "volume"))


@register("stream_rolling", f"""
WITH t AS (SELECT event_type AS stock_code, value, ts, date_trunc('hour', ts) AS h FROM events
           WHERE value IS NOT NULL AND ts IS NOT NULL),
x AS (SELECT stock_code, value, h - to_hours(k) AS window_start FROM t, (SELECT unnest([0, 1, 2]) AS k)),
w AS (SELECT stock_code, window_start, window_start + INTERVAL 3 HOUR AS window_end, avg(value) AS mean_value,
             count(*) AS n_ticks FROM x GROUP BY 1, 2)
SELECT stock_code, window_start, window_end, {rnd(['mean_value'])}, n_ticks FROM w
WHERE window_end <= (SELECT max(ts) FROM events WHERE value IS NOT NULL) - INTERVAL 10 MINUTE""", ids="Z5")
def q_stream_rolling(spark, d):
    root = _scratch(spark, "rolling")
    ticks = ZB.tick_stream(spark, d, glob="events.parquet")
    ZB.run_to_folder(ZB.stream_rolling(ticks), f"{root}/out", f"{root}/ck")
    return finalize(spark.read.parquet(f"{root}/out"))


# -- Z3, Z4, N6: bars applied in time order, however they arrive ---------------------------
DELAY = "1 day"
LATE = "2024-01-05 00:00:00"     # bars of this time come once more, far behind the watermark
TURN = "2024-01-15 00:00:00"     # the first batch ends here, without some bars of its last 12 hours


def _shuffled_stream(spark, d, root):
    """Clean hourly bars as a stream of three batches: the second brings bars that are out of order
    within the delay, the third bars that are behind the watermark."""
    bars = clean_panel(spark, d)
    turn = F.lit(TURN).cast("timestamp_ntz")
    missing = (F.col("date") >= turn - F.expr("INTERVAL 12 HOURS")) & (F.hour("date") % 5 == 0)
    first = (F.col("date") < turn) & ~missing
    for part in (bars.where(first), bars.where(~first), bars.where(F.col("date") == F.lit(LATE).cast("timestamp_ntz"))):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


_APPLIED = f"date <= (SELECT max(date) FROM src) - INTERVAL {DELAY.upper()}"
_SRC = f"""WITH RECURSIVE bars AS ({BAR_SQL['events']}),
clean AS (SELECT * FROM bars WHERE {{valid}}),
src AS (SELECT stock_code, date, open, high, low, close, volume, row_number() OVER ({W}) AS rn FROM clean)"""


def _in_order_sql(ctes: str, table: str, column: str) -> str:
    from barlake.plans.common import VALID_SQL
    return (_SRC.format(valid=VALID_SQL) + ctes + f"""
SELECT src.stock_code, src.date, {rnd_expr('src.close')} AS close, false AS late, {rnd_expr(column)} AS {column}
FROM src LEFT JOIN {table} USING (stock_code, rn) WHERE {_APPLIED}
UNION ALL SELECT stock_code, date, {rnd_expr('close')}, true, NULL FROM src WHERE date = TIMESTAMP '{LATE}'""")


def _drained(spark, stream, root):
    ZB.run_to_folder(stream, f"{root}/out", f"{root}/ck")
    return finalize(spark.read.parquet(f"{root}/out"))


@register("stream_ema", _in_order_sql(ema_cte("e", "src", "close", 10) + ",\ne_o AS (SELECT stock_code, rn, e AS ema_10 FROM e)",
                                      "e_o", "ema_10"), check="REC", ids="Z3")
def q_stream_ema(spark, d):
    root = _scratch(spark, "ema")
    return _drained(spark, ZO.stream_ema(_shuffled_stream(spark, d, root), 10, DELAY), root)


@register("stream_rsi", _in_order_sql(rsi_cte(14), "r14_o", "rsi_14"), check="REC", ids="Z3")
def q_stream_rsi(spark, d):
    root = _scratch(spark, "rsi")
    return _drained(spark, ZO.stream_rsi(_shuffled_stream(spark, d, root), 14, DELAY), root)


@register("stream_windows", with_bars() + f""",
src AS (SELECT *, count(*) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n_bars,
               avg(close) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean5,
               max(high) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS top FROM clean)
SELECT stock_code, date, n_bars, {rnd_expr('CASE WHEN n_bars >= 5 THEN mean5 END')} AS mean_close_5, {rnd_expr('top')} AS high_10
FROM src WHERE {_APPLIED}""", ids="Z4 (look-back state)")
def q_stream_windows(spark, d):
    root = _scratch(spark, "windows")
    rows = ZO.stream_windows(_shuffled_stream(spark, d, root), 10, DELAY).where("not late")
    high = F.array_max(F.transform("window", lambda r: r[ZO.BAR.index("high")]))
    return _drained(spark, rows.select("stock_code", "date", F.size("window").alias("n_bars"),
                                       ZO.back_mean("close", 5).alias("mean_close_5"), high.alias("high_10")), root)


@register("stream_scores", with_bars() + f""",
src AS (SELECT stock_code, date, close, close / lag(close) OVER ({W}) - 1 AS r, lead(close) OVER ({W}) / close - 1 AS y FROM clean),
fit AS (SELECT regr_slope(y, r) AS b, regr_intercept(y, r) AS a FROM src WHERE r IS NOT NULL AND y IS NOT NULL)
SELECT stock_code, date, {rnd_expr('close')} AS close, {rnd_expr('a + b * coalesce(r, 0)', 4)} AS predicted_return
FROM src, fit WHERE {_APPLIED}""", ids="Z4 N6")
def q_stream_scores(spark, d):
    """Real-time scoring: a linear model of the last return, fit on batch bars, scores streamed bars
    from the look-back state of their instrument."""
    hist = next_return_label(clean_panel(spark, d).withColumn("return_1d", S.pct_change("close", 1)))
    model = M.fit("linear", hist, ["return_1d"], "target_return_1d")
    root = _scratch(spark, "scores")
    feats = {"return_1d": F.try_divide(ZO.back("close"), ZO.back("close", 1)) - 1}
    ZB.run_to_folder(ZO.score_stream(_shuffled_stream(spark, d, root), model, feats, 10, DELAY), f"{root}/out", f"{root}/ck")
    return finalize(spark.read.parquet(f"{root}/out"), overrides={"predicted_return": 4})
