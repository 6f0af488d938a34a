"""Catalog: joins, unions, grouped stats, rollups, universes, calendars, sinks, sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barlake.operators import relational as J
from barlake.plans.catalog import register
from barlake.plans.common import BAR_SQL, W, clean_panel, finalize, rnd, rnd_expr, with_bars
from barlake.plans.q_eval import PRED_SQL, wide_predictions
from barlake.session import scratch_path
from barlake.sources import files as IO
from barlake.sources.panels import load_panel, table
from barlake.sources.runs import read_run


@register("key_join", PRED_SQL + f"""
SELECT w.stock_code, w.date, {rnd_expr('w.momentum')} AS momentum,
       {rnd_expr('c.volume')} AS volume, {rnd_expr('w.y')} AS y
FROM wide w JOIN clean c USING (stock_code, date) WHERE w.y IS NOT NULL""", ids="J1")
def q_key_join(spark, d):
    w = wide_predictions(spark, d).select("stock_code", "date", "momentum", "y").where("y IS NOT NULL")
    bars = clean_panel(spark, d).select("stock_code", "date", "volume")
    return finalize(J.key_join(w.select("stock_code", "date", "momentum"), bars, w.select("stock_code", "date", "y")))


@register("asof_previous_bar", f"""
WITH b AS ({BAR_SQL['events']})
SELECT e.event_id, {rnd_expr('e.value')} AS value, b.date AS prev_bar_date, {rnd_expr('b.close')} AS prev_close
FROM events e ASOF LEFT JOIN b ON e.event_type = b.stock_code AND e.ts >= b.date + INTERVAL 1 HOUR
WHERE e.value IS NOT NULL AND e.ts IS NOT NULL""", ids="J5")
def q_asof(spark, d):
    ev = table(spark, d, "events").where(F.col("value").isNotNull() & F.col("ts").isNotNull())
    bars = load_panel(spark, d)
    out = J.asof_previous_bar(ev.select("event_id", "event_type", "ts", "value"), bars)
    return finalize(out.select("event_id", "value", "prev_bar_date", "prev_close"))


@register("union_panels", f"""
WITH a AS ({BAR_SQL['events']}), c AS ({BAR_SQL['nations']})
SELECT 'events' AS panel, count(*) AS bars, count(amount) AS with_amount FROM a
UNION ALL SELECT 'nations', count(*), 0 FROM c""", ids="C1 C2")
def q_union(spark, d):
    a = load_panel(spark, d, "events")
    c = load_panel(spark, d, "nations").drop("amount").withColumn("date", F.col("date").cast("timestamp_ntz"))
    u = J.union_panels({"events": a, "nations": c})
    return u.groupBy("panel").agg(F.count(F.lit(1)).alias("bars"), F.count("amount").alias("with_amount"))


@register("stock_stats", with_bars() + f""",
m AS (SELECT *, CASE WHEN count(close) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5
                     THEN avg(close) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS ma5 FROM clean)
SELECT stock_code, count(*) AS days, {rnd_expr('avg(close)')} AS mean_close, {rnd_expr('stddev_samp(close)')} AS std_close,
       {rnd_expr('max(high)')} AS max_high, {rnd_expr('min(low)')} AS min_low, {rnd_expr('arg_max(ma5, date)')} AS last_ma5
FROM m GROUP BY stock_code""", ids="A1")
def q_stock_stats(spark, d):
    return finalize(J.instrument_stats(clean_panel(spark, d)))


@register("coverage_rollup", with_bars("nations") + """
SELECT year(date) AS year, month(date) AS month, count(*) AS bars, count(DISTINCT stock_code) AS instruments
FROM clean GROUP BY ROLLUP (year(date), month(date))""", ids="A2")
def q_rollup(spark, d):
    return finalize(J.coverage_rollup(clean_panel(spark, d, "nations")))


_UNIV = """
u AS (SELECT CAST(n_nationkey AS VARCHAR) AS con_code, coalesce(c, 0) / sum(coalesce(c, 0)) OVER () AS weight
      FROM nation JOIN region ON n_regionkey = r_regionkey
      LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) cc ON cc.c_nationkey = n_nationkey
      WHERE r_name = 'ASIA')"""


def _universe(spark, d):
    return J.region_universe(table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "customer"), "ASIA")


@register("constituents", "WITH" + _UNIV + f"\nSELECT DISTINCT con_code AS stock_code, {rnd_expr('weight')} AS weight FROM u",
          ids="S14")
def q_constituents(spark, d):
    return finalize(IO.constituents(_universe(spark, d)))


@register("semi_universe", with_bars("nations") + "," + _UNIV + f"""
SELECT stock_code, date, {rnd(['close'])} FROM clean WHERE stock_code IN (SELECT con_code FROM u)
  AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""", ids="S12 S13 S17 J3")
def q_semi_universe(spark, d):
    from barlake.operators.clean import clean_bars
    uni = IO.constituents(_universe(spark, d))
    bars = clean_bars(load_panel(spark, d, "nations", "1996-01-01", "1997-12-31"), dedupe=False)
    out = IO.load_bar_range(bars, uni, "1996-01-01", "1997-12-31", ["close"])
    return finalize(out)


@register("index_series", with_bars() + f"""
SELECT stock_code, date, {rnd(['open', 'high', 'low', 'close', 'volume'])}, {rnd(['amount'], 4)} FROM clean
WHERE stock_code = 'purchase' AND CAST(date AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""", ids="S18")
def q_index_series(spark, d):
    from barlake.operators.clean import clean_bars
    bars = clean_bars(load_panel(spark, d, "events", "2024-01-10", "2024-01-20"), dedupe=False)
    return finalize(IO.load_index_series(bars, "purchase", "2024-01-10", "2024-01-20"),
                    overrides={"amount": 4})


_CAL = with_bars("nations") + """,
days AS (SELECT DISTINCT CAST(date AS DATE) AS d FROM clean),
cal AS (SELECT strftime(g.d, '%Y%m%d') AS cal_date, CASE WHEN days.d IS NULL THEN 0 ELSE 1 END AS is_open
        FROM (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM days) g
        LEFT JOIN days ON g.d = days.d)"""


@register("latest_trading_date", _CAL + """,
today AS (SELECT max(d) AS t FROM days)
SELECT max(strptime(cal_date, '%Y%m%d')::DATE) AS latest_trading_date FROM cal, today
WHERE is_open = 1 AND strptime(cal_date, '%Y%m%d')::DATE BETWEEN t - INTERVAL 10 DAY AND t""", ids="S10")
def q_latest_trading(spark, d):
    bars = clean_panel(spark, d, "nations")
    cal = J.trading_calendar(bars)
    today = bars.agg(F.max(F.to_date("date"))).scalar()
    return IO.latest_trading_date(cal, today=today)


@register("weekday_fallback", with_bars("nations") + """
SELECT DISTINCT CAST(date AS DATE) AS d, CAST(date AS DATE) - CAST(greatest(isodow(date) - 1 - 4, 0) AS INTEGER) AS trading_day
FROM clean""", ids="S11")
def q_weekday(spark, d):
    days = clean_panel(spark, d, "nations").select(F.to_date("date").alias("d")).distinct()
    return days.withColumn("trading_day", IO.weekday_fallback("d"))


@register("save_reload_csv", with_bars() + f"""
SELECT stock_code, CAST(date AS DATE) AS date, {rnd(['open', 'close', 'high', 'low', 'volume'])}, {rnd(['amount'], 4)}
FROM clean""", ids="K1 K4 K8 S1 S3 S6 S7 S8")
def q_save_reload(spark, d):
    """Write the panel as a vendor-style CSV (localised headers, daily dates),
    read it back through the standardising reader."""
    path = scratch_path(spark, f"csv/{uuid.uuid4().hex}")
    bars = clean_panel(spark, d).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    inv = {v: k for k, v in IO.COLUMN_MAP.items()}
    bars.select(*[F.col(c).alias(inv.get(c, c)) for c in bars.columns]).write.option("header", True).csv(path)
    back = IO.read_bars(spark, path, fmt="csv")
    return finalize(back.select("stock_code", "date", "open", "close", "high", "low", "volume", "amount"),
                    overrides={"amount": 4})


@register("partitioned_sink", with_bars("nations") + """
SELECT year(date) AS year, count(*) AS bars FROM clean GROUP BY 1""", ids="K1")
def q_partitioned_sink(spark, d):
    path = scratch_path(spark, f"panel/{uuid.uuid4().hex}")
    IO.save_bars(clean_panel(spark, d, "nations"), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("year").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("bars"))


@register("csv_sink", with_bars("nations") + f"""
SELECT stock_code, date, {rnd(["open", "close"])} FROM clean""", ids="K8 K4 S1")
def q_csv_sink(spark, d):
    """The CSV arm of the sink: bars written as text and read back through the readers."""
    path = scratch_path(spark, f"csv/{uuid.uuid4().hex}")
    inv = {v: k for k, v in IO.COLUMN_MAP.items()}
    bars = clean_panel(spark, d, "nations")
    IO.save_bars(bars.select(*[F.col(c).alias(inv.get(c, c)) for c in bars.columns]), path, fmt="csv")
    return finalize(IO.read_bars(spark, path, fmt="csv").select("stock_code", "date", "open", "close"))


@register("cached_stage", with_bars() + """
SELECT stock_code, count(*) AS bars, count(*) AS bars_first FROM clean GROUP BY 1""", ids="S16")
def q_cached_stage(spark, d):
    root = scratch_path(spark, f"cache/{uuid.uuid4().hex}")
    first = IO.cached_stage(spark, clean_panel(spark, d), root, "bars_events")
    again = IO.cached_stage(spark, clean_panel(spark, d), root, "bars_events")
    return again.groupBy("stock_code").agg(F.count(F.lit(1)).alias("bars")).join(
        first.groupBy("stock_code").agg(F.count(F.lit(1)).alias("bars_first")), "stock_code")


@register("sequence_windows", with_bars() + f""",
s AS (SELECT stock_code, date, list([close, volume]) OVER ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS sq,
             lead(close) OVER ({W}) AS target FROM clean)
SELECT stock_code, date, len(sq) AS seq_len, {rnd_expr('sq[1][1]')} AS first_close,
       {rnd_expr('sq[30][1]')} AS last_close, {rnd_expr('target')} AS target
FROM s WHERE len(sq) = 30 AND target IS NOT NULL""", ids="G13")
def q_sequences(spark, d):
    s = J.sequence_windows(clean_panel(spark, d), ["close", "volume"], "close", 30)
    return finalize(s.select("stock_code", "date", F.size("sequence").cast("bigint").alias("seq_len"),
                             F.col("sequence")[0][0].alias("first_close"),
                             F.element_at("sequence", -1)[0].alias("last_close"), "target"))


@register("sequences_scaled", with_bars("suppliers") + f""",
mm AS (SELECT min(close) AS c0, max(close) AS c1, min(volume) AS v0, max(volume) AS v1 FROM clean),
z AS (SELECT stock_code, date, (close - c0) / (c1 - c0) AS c, (volume - v0) / (v1 - v0) AS v FROM clean, mm),
s AS (SELECT stock_code, date, list(c) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS cs, v, lead(c) OVER ({W}) AS target FROM z)
SELECT stock_code, date, {rnd_expr('cs[1]')} AS first_close, {rnd_expr('cs[60]')} AS last_close, {rnd_expr('v')} AS last_volume,
       {rnd_expr('target')} AS target FROM s WHERE len(cs) = 60 AND target IS NOT NULL""", ids="G13 P18")
def q_sequences_scaled(spark, d):
    """Sequences of 60 bars of many instruments, features and label scaled to [0, 1]."""
    bars = clean_panel(spark, d, "suppliers")
    s = J.sequence_windows(bars, ["close", "volume"], "close", 60, scale=J.sequence_scale(bars, ["close", "volume"], "close"))
    return finalize(s.select("stock_code", "date", F.col("sequence")[0][0].alias("first_close"),
                             F.element_at("sequence", -1)[0].alias("last_close"),
                             F.element_at("sequence", -1)[1].alias("last_volume"), "target"))


@register("sequences_latest", with_bars("suppliers") + f""",
mm AS (SELECT min(close) AS c0, max(close) AS c1 FROM clean),
z AS (SELECT stock_code, date, (close - c0) / (c1 - c0) AS c, row_number() OVER (PARTITION BY stock_code ORDER BY date DESC) AS rn,
             count(*) OVER (PARTITION BY stock_code) AS n FROM clean, mm)
SELECT stock_code, max(date) AS date, least(max(n), 80) AS n_rows, {rnd_expr('max(CASE WHEN rn = 1 THEN c END)')} AS last_close,
       {rnd_expr('CASE WHEN max(n) >= 80 THEN max(CASE WHEN rn = 80 THEN c END) ELSE max(CASE WHEN rn = 1 THEN c END) END')} AS first_close,
       {rnd_expr('CASE WHEN max(n) >= 80 THEN sum(c) ELSE 80 * max(CASE WHEN rn = 1 THEN c END) END', 4)} AS total
FROM z WHERE rn <= 80 GROUP BY stock_code""", ids="G13 (scoring: short series repeat their last row)")
def q_sequences_latest(spark, d):
    bars = clean_panel(spark, d, "suppliers")
    s = J.latest_sequences(bars, ["close"], 80, scale=J.sequence_scale(bars, ["close"], "close"))
    total = F.aggregate("sequence", F.lit(0.0), lambda a, r: a + r[0])
    return finalize(s.select("stock_code", "date", "n_rows", F.element_at("sequence", -1)[0].alias("last_close"),
                             F.col("sequence")[0][0].alias("first_close"), total.alias("total")), overrides={"total": 4})


@register("column_concat", with_bars() + f""",
a AS (SELECT stock_code, date, close FROM clean), b AS (SELECT stock_code, date, volume FROM clean WHERE volume > 2)
SELECT stock_code, date, {rnd(['close', 'volume'])} FROM a FULL JOIN b USING (stock_code, date)""", ids="C2")
def q_column_concat(spark, d):
    bars = clean_panel(spark, d)
    return finalize(J.column_concat(bars.select("stock_code", "date", "close"),
                                    bars.where("volume > 2").select("stock_code", "date", "close", "volume")))


@register("feature_registry", None, check="ROWS", ids="X1 X2 F18")
def q_feature_registry(spark, d):
    """Registered feature stages chained with DataFrame.transform, plus a
    user kernel (running max drawdown of the close) in the shared grouped map."""
    import numpy as np
    from barlake.operators import recursive as R
    from barlake.operators.registry import apply_features

    def drawdown(a):
        c = a["close"]
        return {"close_drawdown": c / np.maximum.accumulate(c) - 1}

    R.register_kernel("close_drawdown", drawdown, ["close_drawdown"])
    out, added = apply_features(clean_panel(spark, d), ["price", "kdj", "time"])
    out = R.apply_recursive(out, ("close_drawdown",))
    return finalize(out.select("stock_code", "date", *added, "close_drawdown"))


@register("prepare_panel", None, check="ROWS", ids="S2 P2 K1 K2 (data preparation plan)")
def q_prepare(spark, d):
    from barlake.plans.prepare import prepare_and_write
    path = scratch_path(spark, f"prepared/{uuid.uuid4().hex}")
    return prepare_and_write(load_panel(spark, d, "nations").withColumn("date", F.to_date("date")), path)


@register("train_plan", None, check="ROWS", ids="L8 P19 E7 E8 (training plan)")
def q_train_plan(spark, d):
    from barlake.plans.train import train
    name, _, hist, chosen = train(clean_panel(spark, d), method="correlation", threshold=0.05)
    return hist.withColumn("selected_features", F.lit(",".join(chosen))).withColumn("best", F.col("model") == name)


@register("score_plan", None, check="ROWS", ids="Q1 Q2 K3 K4 K5 K6 (prediction plan)")
def q_score_plan(spark, d):
    from barlake.plans.score import save_predictions, score_latest
    from barlake.plans.train import train
    bars = clean_panel(spark, d)
    name, fitted, _, _ = train(bars, models=("ridge",), method="correlation", threshold=0.05)
    pred, ranked = score_latest(bars, fitted[name], n=2)
    root = scratch_path(spark, f"predictions/{uuid.uuid4().hex}")
    return read_run(spark, root, "submission", save_predictions(pred, ranked, root))
