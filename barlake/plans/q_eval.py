"""Catalog: evaluation, prediction statistics, ensembles, portfolio (V*, Q3, Q4, U5, E1-E3, N1, N7, M9).

Predictions come from three deterministic rules over the bar panel so the
oracle stays plain SQL: ``momentum`` (p = last one-bar return), ``reversal``
(p = minus that) and ``ma_gap`` (p = close / MA5 - 1); the label is the
next-bar return ``target_return_1d`` (M9).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.windows import DEFAULT as S
from barlake.functions.windows import div
from barlake.operators import evaluate as V
from barlake.operators import portfolio as N
from barlake.operators import ranking as Q
from barlake.plans.catalog import register
from barlake.plans.common import W, clean_panel, finalize, rnd, rnd_expr, with_bars
from barlake.session import scratch_path
from barlake.sources import runs

MODELS = ("momentum", "reversal", "ma_gap")


def wide_predictions(spark, d, panel: str = "events") -> DataFrame:
    bars = clean_panel(spark, d, panel)
    r1 = S.pct_change("close", 1)
    return bars.select("stock_code", "date", "close",
                       (div(S.lead("close"), "close") - 1).alias("y"),
                       r1.alias("momentum"), (-r1).alias("reversal"),
                       (div("close", S.mean("close", 5)) - 1).alias("ma_gap"))


def long_predictions(spark, d, panel: str = "events") -> DataFrame:
    w = wide_predictions(spark, d, panel)
    long = w.unpivot(["stock_code", "date", "y"], list(MODELS), "model", "p")
    return long.where(F.col("y").isNotNull() & F.col("p").isNotNull())


PRED_SQL = with_bars() + f""",
pf AS (SELECT stock_code, date, close, lead(close) OVER ({W}) / nullif(close, 0) - 1 AS y,
              close / nullif(lag(close) OVER ({W}), 0) - 1 AS r1,
              CASE WHEN count(close) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5
                   THEN avg(close) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS ma5 FROM clean),
wide AS (SELECT stock_code, date, close, y, r1 AS momentum, -r1 AS reversal, close / nullif(ma5, 0) - 1 AS ma_gap FROM pf),
preds AS (SELECT * FROM (
    SELECT 'momentum' AS model, stock_code, date, y, momentum AS p FROM wide
    UNION ALL SELECT 'reversal', stock_code, date, y, reversal FROM wide
    UNION ALL SELECT 'ma_gap', stock_code, date, y, ma_gap FROM wide) WHERE y IS NOT NULL AND p IS NOT NULL)"""

_REG = ["mse", "rmse", "mae", "r2", "adj_r2", "mape", "pearson_corr", "information_coefficient",
        "max_error", "median_ae", "direction_accuracy"]

_REG_SQL = PRED_SQL + f""",
m AS (SELECT model, count(*) AS n, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae,
             var_pop(y) AS vy, avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) AS mape,
             covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0) AS pearson_corr,
             max(abs(y - p)) AS max_error, median(abs(y - p)) AS median_ae,
             avg(CASE WHEN sign(y) = sign(p) THEN 1.0 ELSE 0.0 END) AS direction_accuracy
      FROM preds GROUP BY model),
m2 AS (SELECT *, sqrt(mse) AS rmse, 1 - mse / nullif(vy, 0) AS r2, pearson_corr AS information_coefficient FROM m),
m3 AS (SELECT *, CASE WHEN n > 2 THEN 1 - (1 - r2) * (n - 1) / (n - 2) ELSE r2 END AS adj_r2 FROM m2)
SELECT model, n, {rnd(_REG)} FROM m3"""


@register("regression_metrics", _REG_SQL, ids="V1 V2 V3 V4 V6 V7 V9")
def q_regression_metrics(spark, d):
    return finalize(V.regression_metrics(long_predictions(spark, d)).select("model", "n", *_REG))


@register("spearman", PRED_SQL + f""",
rk AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY y) + (count(*) OVER (PARTITION BY model, y) - 1) / 2.0 AS ry,
              rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS rp
       FROM preds)
SELECT model, {rnd_expr('covar_pop(ry, rp) / nullif(stddev_pop(ry) * stddev_pop(rp), 0)')} AS spearman_corr
FROM rk GROUP BY model""", ids="V5")
def q_spearman(spark, d):
    return finalize(V.spearman(long_predictions(spark, d)))


@register("quintile_accuracy", PRED_SQL + f""",
q AS (SELECT model, quantile_cont(y, [0.2, 0.4, 0.6, 0.8]) AS qs FROM preds GROUP BY model),
l AS (SELECT p.*, CASE WHEN y <= qs[1] THEN 'q1' WHEN y <= qs[2] THEN 'q2' WHEN y <= qs[3] THEN 'q3'
                       WHEN y <= qs[4] THEN 'q4' END AS layer FROM preds p JOIN q USING (model))
SELECT model, layer, {rnd_expr('avg(CASE WHEN sign(y) = sign(p) THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n
FROM l WHERE layer IS NOT NULL GROUP BY model, layer""", ids="V8")
def q_quintile(spark, d):
    return finalize(V.quintile_accuracy(long_predictions(spark, d)))


@register("information_ratio", PRED_SQL + f""",
pos AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY date, stock_code) - 1 AS pos,
               count(*) OVER (PARTITION BY model) AS n FROM preds),
st AS (SELECT model, unnest(range(0, n - 20, 5)) AS s FROM (SELECT DISTINCT model, n FROM pos)),
win AS (SELECT st.model, st.s, covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0) AS ic
        FROM st JOIN pos ON pos.model = st.model AND pos.pos BETWEEN st.s AND st.s + 19 GROUP BY st.model, st.s),
sp AS (SELECT model, stddev_pop(ic) AS ic_std, count(ic) AS n_windows FROM win WHERE ic IS NOT NULL GROUP BY model),
tot AS (SELECT model, covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0) AS information_coefficient
        FROM preds GROUP BY model)
SELECT model, {rnd(['information_coefficient', 'ic_std'])}, n_windows,
       {rnd_expr('CASE WHEN ic_std > 0 THEN information_coefficient / ic_std ELSE 0.0 END')} AS information_ratio
FROM tot LEFT JOIN sp USING (model)""", ids="V10")
def q_information_ratio(spark, d):
    return finalize(V.information_ratio(long_predictions(spark, d)))


@register("portfolio_sharpe", PRED_SQL + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p DESC, date DESC, stock_code DESC) AS r,
              count(*) OVER (PARTITION BY model) AS n FROM preds),
pk AS (SELECT * FROM rk WHERE n < 10 OR r <= least(10, n // 10))
SELECT model, {rnd_expr('avg(y)')} AS portfolio_return, count(*) AS top_n,
       {rnd_expr('CASE WHEN stddev_pop(y) > 0 THEN avg(y) / stddev_pop(y) ELSE 0.0 END')} AS sharpe_ratio
FROM pk GROUP BY model""", ids="V11 V12")
def q_portfolio(spark, d):
    return finalize(V.portfolio_metrics(long_predictions(spark, d)))


@register("jarque_bera", PRED_SQL + f""",
e AS (SELECT model, y - p AS e FROM preds),
mo AS (SELECT e.model, count(*) AS n, avg(power(e - mu, 2)) AS m2, avg(power(e - mu, 3)) AS m3, avg(power(e - mu, 4)) AS m4
       FROM e JOIN (SELECT model, avg(e) AS mu FROM e GROUP BY model) USING (model) GROUP BY e.model),
sk AS (SELECT model, n, m3 / power(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis FROM mo),
jb AS (SELECT *, n / 6.0 * (skewness * skewness + kurtosis * kurtosis / 4.0) AS jarque_bera FROM sk)
SELECT model, n, {rnd(['skewness', 'kurtosis'])}, {rnd(['jarque_bera'], 3)},
       {rnd_expr('exp(-jarque_bera / 2)')} AS jb_pvalue, exp(-jarque_bera / 2) > 0.05 AS residuals_normal FROM jb""",
          ids="V14")
def q_jarque_bera(spark, d):
    return finalize(V.jarque_bera(long_predictions(spark, d)), overrides={"jarque_bera": 3})


@register("durbin_watson", PRED_SQL + f""",
e AS (SELECT model, y - p AS e, (y - p) - lag(y - p) OVER (PARTITION BY model, stock_code ORDER BY date) AS de FROM preds),
dw AS (SELECT model, sum(de * de) / nullif(sum(e * e), 0) AS durbin_watson FROM e GROUP BY model)
SELECT model, {rnd(['durbin_watson'])}, durbin_watson BETWEEN 1.5 AND 2.5 AS no_autocorrelation FROM dw""",
          ids="V15")
def q_durbin_watson(spark, d):
    return finalize(V.durbin_watson(long_predictions(spark, d)))


@register("breusch_pagan", PRED_SQL + f"""
SELECT model, count(*) AS n, {rnd_expr('regr_r2((y - p) * (y - p), p)')} AS bp_r2,
       {rnd_expr('count(*) * regr_r2((y - p) * (y - p), p)', 4)} AS bp_lm
FROM preds GROUP BY model""", ids="V16")
def q_breusch_pagan(spark, d):
    out = V.breusch_pagan(long_predictions(spark, d), with_pvalue=False)
    return finalize(out, overrides={"bp_lm": 4})


@register("residual_tests", None, check="ROWS", ids="V14 V15 V16 (with p-values)")
def q_residual_tests(spark, d):
    lp = long_predictions(spark, d)
    out = V.jarque_bera(lp).join(V.durbin_watson(lp), "model").join(V.breusch_pagan(lp).drop("n"), "model")
    return finalize(out)


@register("residual_histogram", PRED_SQL + f""",
e AS (SELECT model, y - p AS e FROM preds),
r AS (SELECT model, min(e) AS lo, max(e) AS hi, count(*) AS n FROM e GROUP BY model),
b AS (SELECT e.model, CAST(CASE WHEN (hi - lo) / 30 > 0 THEN least(floor((e - lo) / ((hi - lo) / 30)) + 1, 30)
                           ELSE 1 END AS BIGINT) AS bin, lo, hi, n FROM e JOIN r USING (model))
SELECT model, bin, {rnd_expr('lo + (bin - 1) * (hi - lo) / 30')} AS bin_start, count(*) AS count,
       {rnd_expr('count(*) / (n * (hi - lo) / 30)', 4)} AS density
FROM b GROUP BY model, bin, lo, hi, n""", ids="V17")
def q_residual_histogram(spark, d):
    return finalize(V.residual_histogram(long_predictions(spark, d)), overrides={"density": 4})


@register("residual_qq", PRED_SQL + f""",
e AS (SELECT model, stock_code, date, y - p AS residual FROM preds),
s AS (SELECT model, count(*) AS n, avg(residual) AS fit_mean, stddev_pop(residual) AS fit_std FROM e GROUP BY model)
SELECT model, row_number() OVER (PARTITION BY model ORDER BY residual, date, stock_code) AS i, {rnd(['residual'])},
       {rnd_expr('(row_number() OVER (PARTITION BY model ORDER BY residual, date, stock_code) - 0.5) / n')} AS plotting_position,
       {rnd(['fit_mean', 'fit_std'])}
FROM e JOIN s USING (model)""", ids="V18")
def q_residual_qq(spark, d):
    return finalize(V.residual_qq(long_predictions(spark, d)))


@register("model_summary", _REG_SQL.replace(f"SELECT model, n, {rnd(_REG)} FROM m3",
                                            f"SELECT model, {rnd(['rmse', 'mae', 'r2'])}, "
                                            "row_number() OVER (ORDER BY rmse, model) AS rank FROM m3"),
          ids="V13 V19")
def q_model_summary(spark, d):
    m = V.regression_metrics(long_predictions(spark, d)).select("model", "rmse", "mae", "r2")
    return finalize(V.model_ranking(m))


_ALL_SQL = PRED_SQL + f""",
m AS (SELECT model, count(*) AS n, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS vy,
             avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) AS mape,
             covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0) AS pearson_corr,
             max(abs(y - p)) AS max_error, median(abs(y - p)) AS median_ae,
             avg(CASE WHEN sign(y) = sign(p) THEN 1.0 ELSE 0.0 END) AS direction_accuracy FROM preds GROUP BY model),
m2 AS (SELECT *, sqrt(mse) AS rmse, 1 - mse / nullif(vy, 0) AS r2, pearson_corr AS information_coefficient FROM m),
m3 AS (SELECT *, CASE WHEN n > 2 THEN 1 - (1 - r2) * (n - 1) / (n - 2) ELSE r2 END AS adj_r2 FROM m2),
rk AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY y) + (count(*) OVER (PARTITION BY model, y) - 1) / 2.0 AS ry,
              rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS rp FROM preds),
sp AS (SELECT model, covar_pop(ry, rp) / nullif(stddev_pop(ry) * stddev_pop(rp), 0) AS spearman_corr FROM rk GROUP BY model),
pos AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY date, stock_code) - 1 AS pos,
               count(*) OVER (PARTITION BY model) AS nn FROM preds),
st AS (SELECT model, unnest(range(0, nn - 20, 5)) AS s FROM (SELECT DISTINCT model, nn FROM pos)),
win AS (SELECT st.model, st.s, covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0) AS ic
        FROM st JOIN pos ON pos.model = st.model AND pos.pos BETWEEN st.s AND st.s + 19 GROUP BY st.model, st.s),
ics AS (SELECT model, stddev_pop(ic) AS ic_std, count(ic) AS n_windows FROM win WHERE ic IS NOT NULL GROUP BY model),
pr AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p DESC, date DESC, stock_code DESC) AS r,
              count(*) OVER (PARTITION BY model) AS nn FROM preds),
pk AS (SELECT model, avg(y) AS portfolio_return, count(*) AS top_n,
              CASE WHEN stddev_pop(y) > 0 THEN avg(y) / stddev_pop(y) ELSE 0.0 END AS sharpe_ratio
       FROM pr WHERE nn < 10 OR r <= least(10, nn // 10) GROUP BY model),
al AS (SELECT m3.*, sp.spearman_corr, ics.ic_std, ics.n_windows,
              CASE WHEN ics.ic_std > 0 THEN m3.information_coefficient / ics.ic_std ELSE 0.0 END AS information_ratio,
              pk.portfolio_return, pk.top_n, pk.sharpe_ratio
       FROM m3 LEFT JOIN sp USING (model) LEFT JOIN ics USING (model) LEFT JOIN pk USING (model))
SELECT model, n, {rnd(_REG + ["spearman_corr", "ic_std", "information_ratio", "portfolio_return", "sharpe_ratio"])},
       n_windows, top_n, row_number() OVER (ORDER BY rmse, model) AS rank FROM al"""


@register("evaluate_all", _ALL_SQL, ids="V13 (all metrics, all models)")
def q_evaluate_all(spark, d):
    return finalize(V.evaluate_all(long_predictions(spark, d)))


# -- M9 label ------------------------------------------------------------------------
@register("label_next_return", PRED_SQL + f"""
SELECT stock_code, date, {rnd_expr('y')} AS target_return_1d FROM wide""", ids="M9")
def q_label(spark, d):
    from barlake.operators.splits import next_return_label
    out = next_return_label(clean_panel(spark, d))
    return finalize(out.select("stock_code", "date", "target_return_1d"))


# -- Q3 / Q4 / U5 / E1-E3 ---------------------------------------------------------------
_STATS = ["mean", "std", "min", "max", "q5", "q25", "q50", "q75", "q95"]


@register("prediction_stats", PRED_SQL + f""",
m AS (SELECT p FROM preds WHERE model = 'momentum'),
a AS (SELECT count(p) AS count, avg(p) AS mean, stddev_samp(p) AS std, min(p) AS min, max(p) AS max,
             count(*) FILTER (WHERE p > 0) AS positive_count, count(*) FILTER (WHERE p < 0) AS negative_count,
             count(*) FILTER (WHERE p = 0) AS zero_count,
             quantile_cont(p, [0.05, 0.25, 0.5, 0.75, 0.95]) AS qs FROM m)
SELECT count, positive_count, negative_count, zero_count, {rnd(['mean', 'std', 'min', 'max'])},
       {", ".join(f"{rnd_expr(f'qs[{i + 1}]')} AS q{q}" for i, q in enumerate((5, 25, 50, 75, 95)))} FROM a""",
          ids="Q3")
def q_prediction_stats(spark, d):
    lp = long_predictions(spark, d).where("model = 'momentum'")
    return finalize(Q.prediction_stats(lp, "p"))


_LATEST = f""",
lt AS (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY date DESC) = 1),
top AS (SELECT *, row_number() OVER (ORDER BY momentum DESC NULLS LAST, stock_code) AS rank, 'top_gainers' AS category
        FROM lt ORDER BY momentum DESC NULLS LAST, stock_code LIMIT 2),
bot AS (SELECT *, row_number() OVER (ORDER BY momentum, stock_code DESC) AS rank, 'top_losers' AS category
        FROM lt WHERE momentum IS NOT NULL ORDER BY momentum, stock_code DESC LIMIT 2),
rk AS (SELECT * FROM top UNION ALL SELECT * FROM bot)"""


@register("prediction_listing", PRED_SQL + _LATEST + """
SELECT category, rank, stock_code, format('{:.4f}', momentum) AS return_text,
       format('{:.2f}', momentum * 100) || '%' AS percent_text FROM rk""", ids="Q4 Q1")
def q_prediction_listing(spark, d):
    latest = Q.latest_rows(wide_predictions(spark, d))
    ranked = Q.top_bottom(Q.predict_price(latest, "momentum"), 2, score="momentum")
    return Q.prediction_listing(ranked, "momentum")


@register("submission_record", PRED_SQL + _LATEST + """
SELECT list(stock_code ORDER BY rank) FILTER (category = 'top_gainers') AS top_gainers_codes,
       list(round(momentum, 6) ORDER BY rank) FILTER (category = 'top_gainers') AS top_gainers_returns,
       list(stock_code ORDER BY rank) FILTER (category = 'top_losers') AS top_losers_codes,
       list(round(momentum, 6) ORDER BY rank) FILTER (category = 'top_losers') AS top_losers_returns FROM rk""", ids="K3 K6")
def q_submission_record(spark, d):
    latest = Q.latest_rows(wide_predictions(spark, d))
    ranked = Q.top_bottom(latest, 2, score="momentum").withColumn("momentum", F.round("momentum", 6))
    return Q.submission_record(ranked, "momentum")


_ENS_SQL = PRED_SQL + f""",
e AS (SELECT stock_code, date, momentum, reversal, ma_gap,
             list_filter([momentum, reversal, ma_gap], lambda x: x IS NOT NULL) AS xs FROM wide),
e2 AS (SELECT *, list_sort(xs) AS s, len(xs) AS k FROM e)
SELECT stock_code, date,
  {rnd_expr('CASE WHEN k > 0 THEN list_sum(xs) / k END')} AS ensemble_average,
  {rnd_expr('(coalesce(momentum * 0.4, 0) + coalesce(reversal * 0.4, 0) + coalesce(ma_gap * 0.2, 0)) / '
            'nullif((CASE WHEN momentum IS NOT NULL THEN 0.4 ELSE 0 END) + (CASE WHEN reversal IS NOT NULL THEN 0.4 ELSE 0 END) '
            '+ (CASE WHEN ma_gap IS NOT NULL THEN 0.2 ELSE 0 END), 0)')} AS ensemble_weighted,
  {rnd_expr('CASE WHEN k = 0 THEN NULL WHEN k % 2 = 1 THEN s[k // 2 + 1] ELSE (s[k // 2] + s[k // 2 + 1]) / 2 END')} AS ensemble_median
FROM e2"""


@register("ensembles", _ENS_SQL, ids="E1 E2 E3")
def q_ensembles(spark, d):
    w = wide_predictions(spark, d)
    w = Q.ensemble_average(w, list(MODELS), "ensemble_average")
    w = Q.ensemble_weighted(w, {"momentum": 0.4, "reversal": 0.4, "ma_gap": 0.2}, "ensemble_weighted")
    w = Q.ensemble_median(w, list(MODELS), "ensemble_median")
    return finalize(w.select("stock_code", "date", "ensemble_average", "ensemble_weighted", "ensemble_median"))


@register("confidence", PRED_SQL + f""",
u AS (SELECT stock_code, date, abs(momentum - ma_gap) AS uncertainty FROM wide WHERE momentum IS NOT NULL AND ma_gap IS NOT NULL),
mx AS (SELECT max(uncertainty) AS m FROM u)
SELECT stock_code, date, {rnd(['uncertainty'])}, {rnd_expr('1 - uncertainty / (m + 1e-8)')} AS confidence,
       uncertainty < 0.05 AS high_confidence FROM u, mx""", ids="U5")
def q_confidence(spark, d):
    w = wide_predictions(spark, d).where(F.col("momentum").isNotNull() & F.col("ma_gap").isNotNull())
    u = w.select("stock_code", "date", F.abs(F.col("momentum") - F.col("ma_gap")).alias("uncertainty"))
    return finalize(Q.confidence(u))


@register("confidence_default", PRED_SQL + """
SELECT stock_code, date, 0.0::double AS uncertainty, 1.0::double AS confidence, true AS high_confidence FROM wide""", ids="U1")
def q_confidence_default(spark, d):
    return finalize(Q.confidence(Q.zero_uncertainty(wide_predictions(spark, d).select("stock_code", "date"))))


@register("predicted_price", PRED_SQL + f"""
SELECT stock_code, date, {rnd_expr('close')} AS current_price, {rnd_expr('close * (1 + momentum)')} AS predicted_price
FROM (SELECT stock_code, date, momentum FROM wide) JOIN (SELECT stock_code, date, close FROM clean) USING (stock_code, date)""", ids="Q1")
def q_predicted_price(spark, d):
    both = wide_predictions(spark, d).select("stock_code", "date", "momentum").join(
        clean_panel(spark, d).select("stock_code", "date", "close"), ["stock_code", "date"])
    return finalize(Q.predict_price(both, "momentum").select("stock_code", "date", "current_price", "predicted_price"))


# -- K3-K7: outputs of a committed run, read back -----------------------------------------
def _evaluated_run(spark, d) -> str:
    root = scratch_path(spark, f"runs/{uuid.uuid4().hex}")
    metrics = V.regression_metrics(long_predictions(spark, d)).select("model", "n", *_REG)
    ranking = V.model_ranking(metrics.select("model", "rmse", "mae", "r2"))
    runs.write_evaluation(metrics, metrics.select("model", "n", "rmse"), ranking, root)
    return root


@register("run_metrics", _REG_SQL, ids="K7 (metrics, read back from the committed run)")
def q_run_metrics(spark, d):
    return finalize(runs.read_run(spark, _evaluated_run(spark, d), "metrics_json"))


@register("run_ranking", _REG_SQL.replace(f"SELECT model, n, {rnd(_REG)} FROM m3",
                                          f"SELECT model, n, {rnd(['rmse', 'mae', 'r2'])}, "
                                          "row_number() OVER (ORDER BY rmse, model) AS rank FROM m3"),
          ids="K7 V19 (summary and ranking, read back)")
def q_run_ranking(spark, d):
    root = _evaluated_run(spark, d)
    summary = runs.read_run(spark, root, "summary").select("model", "n")
    return finalize(runs.read_run(spark, root, "ranking").join(summary, "model"))


@register("run_predictions", PRED_SQL + _LATEST + f"""
SELECT stock_code, {rnd(['momentum'])}, rank, category, (SELECT count(*) FROM lt) AS n_detailed FROM rk""",
          ids="K3 K4 K5 (submission and detailed predictions, read back)")
def q_run_predictions(spark, d):
    from barlake.plans.score import save_predictions
    root = scratch_path(spark, f"runs/{uuid.uuid4().hex}")
    latest = Q.latest_rows(wide_predictions(spark, d)).select("stock_code", "date", "momentum")
    run = save_predictions(latest, Q.submission(latest, 2, "momentum"), root, score="momentum")
    n = runs.read_run(spark, root, "detailed", run).agg(F.count("*")).scalar()
    return finalize(runs.read_run(spark, root, "submission", run).withColumn("n_detailed", n))


# -- N1 / N7 ------------------------------------------------------------------------------
@register("max_drawdown", PRED_SQL + f""",
eq AS (SELECT stock_code, date, sum(ln(1 + momentum)) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lg
       FROM wide WHERE momentum IS NOT NULL),
dd AS (SELECT stock_code, exp(lg - greatest(0.0, max(lg) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) - 1 AS drawdown FROM eq)
SELECT stock_code, {rnd_expr('min(drawdown)')} AS max_drawdown FROM dd GROUP BY stock_code""",
          ids="N1")
def q_max_drawdown(spark, d):
    w = wide_predictions(spark, d).where(F.col("momentum").isNotNull())
    return finalize(N.max_drawdown(w, "momentum"))


def _supplier_preds(spark, d):
    return wide_predictions(spark, d, "suppliers")


@register("long_short_by_date", with_bars("suppliers") + f""",
pf AS (SELECT stock_code, date, lead(close) OVER ({W}) / nullif(close, 0) - 1 AS y,
              close / nullif(lag(close) OVER ({W}), 0) - 1 AS momentum FROM clean),
x AS (SELECT * FROM pf WHERE y IS NOT NULL AND momentum IS NOT NULL),
t AS (SELECT date, avg(y) AS long_return FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY momentum DESC, stock_code) AS r FROM x)
      WHERE r <= 10 GROUP BY date),
b AS (SELECT date, avg(y) AS short_return FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY momentum, stock_code DESC) AS r FROM x)
      WHERE r <= 10 GROUP BY date)
SELECT date, {rnd(['long_return', 'short_return'])}, {rnd_expr('long_return - short_return')} AS long_short
FROM t JOIN b USING (date)""", ids="N7")
def q_long_short(spark, d):
    return finalize(N.long_short(_supplier_preds(spark, d), "momentum", "y", 10))
