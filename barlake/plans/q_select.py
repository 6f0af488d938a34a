"""Catalog: feature selection (L1-L3, L7, N3) and splits / folds / CV summaries (M1-M8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlake.operators import engineered as E
from barlake.operators import selection as L
from barlake.operators import splits as M
from barlake.plans.catalog import register
from barlake.plans.common import W, clean_panel, finalize, rnd, rnd_expr, with_bars
from barlake.plans.q_eval import PRED_SQL, long_predictions
from barlake.plans.q_features import _corr, _pf, _pp, _vf

FEATURES = ["return_1d", "return_5d", "return_20d", "high_low_ratio_5d", "amplitude",
            "volume_change_1d", "volume_ma_5d", "volume_price_corr", "money_flow", "price_position_10d"]
LABEL = "target_return_1d"


def selection_frame(spark, d):
    bars = clean_panel(spark, d)
    f = E.volume_features(E.price_features(bars))
    f = M.next_return_label(f)
    return f.select("stock_code", "date", *FEATURES, LABEL).where(F.col(LABEL).isNotNull())


_defs = {**_pf, **_pp, **_vf, **_corr}
SEL_SQL = with_bars() + f""",
c2 AS (SELECT *, high / nullif(low, 0) AS hl FROM clean),
sel0 AS (SELECT stock_code, date, {", ".join(f"{_defs[f]} AS {f}" for f in FEATURES)},
                lead(close) OVER ({W}) / nullif(close, 0) - 1 AS {LABEL} FROM c2),
sel AS (SELECT * FROM sel0 WHERE {LABEL} IS NOT NULL)"""


def _corr_sql(a, b):
    return (f"covar_pop({a}, {b}) / nullif(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
            f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0)")


def _unpivot(expr_by_feature: dict, value: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {e} AS {value} FROM agg" for f, e in expr_by_feature.items())


_CORR_SQL = SEL_SQL + f""",
agg AS (SELECT {", ".join(f"abs({_corr_sql(f, LABEL)}) AS {f}" for f in FEATURES)} FROM sel),
sc AS ({_unpivot({f: f for f in FEATURES}, "score")}),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, feature) AS rank FROM sc)
SELECT 'correlation' AS method, feature, {rnd(['score'])}, rank, coalesce(score >= 0.1, false) AS selected FROM rk"""


@register("corr_scores", _CORR_SQL, ids="L1 L9")
def q_corr_scores(spark, d):
    return finalize(L.correlation_scores(selection_frame(spark, d), FEATURES, LABEL, 0.1))


@register("corr_top_k", _CORR_SQL.replace("coalesce(score >= 0.1, false) AS selected",
                                          "coalesce(score >= 0.1 AND rank <= 3, false) AS selected"), ids="N3")
def q_corr_top_k(spark, d):
    return finalize(L.correlation_scores(selection_frame(spark, d), FEATURES, LABEL, 0.1, top_k=3))


_F_SQL = SEL_SQL + f""",
med AS (SELECT {", ".join(f"median({f}) AS m_{f}" for f in FEATURES)} FROM sel),
imp AS (SELECT {LABEL}, {", ".join(f"coalesce({f}, m_{f}) AS {f}" for f in FEATURES)} FROM sel, med),
agg AS (SELECT count(*) AS n, {", ".join(f"{_corr_sql(f, LABEL)} AS {f}" for f in FEATURES)} FROM imp),
sc AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {f} * {f} / nullif(1 - {f} * {f}, 0) * (n - 2) AS score FROM agg" for f in FEATURES)}),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, feature) AS rank FROM sc)
SELECT 'f_score' AS method, feature, {rnd(['score'], 4)}, rank, rank <= 5 AS selected FROM rk"""


@register("f_scores", _F_SQL, ids="L3 P13")
def q_f_scores(spark, d):
    return finalize(L.f_scores(selection_frame(spark, d), FEATURES, LABEL, k=5), overrides={"score": 4})


_QS = ", ".join(repr(i / 10) for i in range(1, 10))
_cols = FEATURES + [LABEL]
_MI_SQL = SEL_SQL + f""",
med AS (SELECT {", ".join(f"median({f}) AS m_{f}" for f in FEATURES)} FROM sel),
imp AS (SELECT {LABEL}, {", ".join(f"coalesce({f}, m_{f}) AS {f}" for f in FEATURES)} FROM sel, med),
ed AS (SELECT {", ".join(f"quantile_cont({c}, [{_QS}]) AS e_{c}" for c in _cols)} FROM imp),
bn AS (SELECT {", ".join(f"len(list_filter(e_{c}, lambda q: q < {c})) AS {c}" for c in _cols)} FROM imp, ed),
lg AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS bx, {LABEL} AS b_y FROM bn" for f in FEATURES)}),
j AS (SELECT feature, bx, b_y, count(*) AS nxy FROM lg GROUP BY ALL),
j2 AS (SELECT *, sum(nxy) OVER (PARTITION BY feature, bx) AS nx, sum(nxy) OVER (PARTITION BY feature, b_y) AS ny,
              sum(nxy) OVER (PARTITION BY feature) AS n FROM j),
sc AS (SELECT feature, sum((nxy / n) * ln(nxy * n / (nx * ny))) AS score FROM j2 GROUP BY feature),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, feature) AS rank FROM sc)
SELECT 'mutual_info' AS method, feature, {rnd(['score'])}, rank, rank <= 5 AS selected FROM rk"""


@register("mutual_info_binned", _MI_SQL, ids="L2")
def q_mutual_info(spark, d):
    return finalize(L.mutual_info_binned(selection_frame(spark, d), FEATURES, LABEL, k=5))


_pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1, len(FEATURES))]
_RC_SQL = SEL_SQL + f""",
agg AS (SELECT {", ".join(f"abs({_corr_sql(FEATURES[i], FEATURES[j])}) AS p_{i}_{j}" for i, j in _pairs)} FROM sel),
pr AS ({" UNION ALL ".join(f"SELECT {j} AS ri, {i} AS li, p_{i}_{j} AS c FROM agg" for i, j in _pairs)}),
dr AS (SELECT ri, min(li) AS because_of FROM pr WHERE c > 0.9 GROUP BY ri),
nm AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {i})" for i, f in enumerate(FEATURES))}) t(feature, idx))
SELECT feature, CAST(idx AS BIGINT) AS idx, because_of IS NULL AS kept FROM nm LEFT JOIN dr ON nm.idx = dr.ri"""


@register("correlated_pairs", _RC_SQL, ids="L7")
def q_correlated(spark, d):
    return finalize(L.remove_correlated(selection_frame(spark, d), FEATURES, 0.9))


# -- M1 / M5 / M6 / M4 / M7 / M8 ---------------------------------------------------------------
_POS = with_bars() + """,
p AS (SELECT stock_code, date, row_number() OVER (ORDER BY date, stock_code) - 1 AS pos, count(*) OVER () AS n FROM clean)"""


@register("time_split", _POS + """
SELECT stock_code, date, CASE WHEN pos < floor(n * 0.7) THEN 'train' WHEN pos < floor(n * 0.8) THEN 'val'
                              ELSE 'test' END AS split FROM p""", ids="M1")
def q_time_split(spark, d):
    return M.time_split(clean_panel(spark, d).select("stock_code", "date")).select("stock_code", "date", "split")


@register("contiguous_folds", _POS + """,
f AS (SELECT *, floor(n / 5) AS base, n - floor(n / 5) * 5 AS extra FROM p)
SELECT stock_code, date, CAST(CASE WHEN pos < extra * (base + 1) THEN floor(pos / (base + 1))
                                   ELSE extra + floor((pos - extra * (base + 1)) / base) END AS BIGINT) AS fold FROM f""",
          ids="M5")
def q_contiguous_folds(spark, d):
    out = M.contiguous_folds(clean_panel(spark, d).select("stock_code", "date"))
    return finalize(out.select("stock_code", "date", "fold"))


@register("holdout_tail", _POS + """
SELECT stock_code, date, CASE WHEN pos < floor(n * 0.8) THEN 'base' ELSE 'meta' END AS split FROM p""", ids="M6")
def q_holdout(spark, d):
    return M.holdout_tail(clean_panel(spark, d).select("stock_code", "date")).select("stock_code", "date", "split")


_FOLDS_SQL = _POS + """,
f AS (SELECT p.*, fold, n - floor(n / 6) * 5 + fold * floor(n / 6) AS start, floor(n / 6) AS ts
      FROM p, (SELECT unnest(range(0, 5)) AS fold)),
r AS (SELECT stock_code, date, fold, CASE WHEN pos < start THEN 'train' WHEN pos < start + ts THEN 'test' END AS role FROM f)"""


@register("ts_folds", _FOLDS_SQL + """
SELECT fold, role, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM r
WHERE role IS NOT NULL GROUP BY fold, role""", ids="M4")
def q_ts_folds(spark, d):
    return finalize(M.fold_roles(M.expanding_blocks(clean_panel(spark, d).select("stock_code", "date"))))


_CV_SQL = PRED_SQL + """,
pp AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY date, stock_code) - 1 AS pos,
              count(*) OVER (PARTITION BY model) AS n FROM preds),
tf AS (SELECT pp.*, fold FROM pp, (SELECT unnest(range(0, 5)) AS fold)
       WHERE pos >= n - floor(n / 6) * 5 + fold * floor(n / 6) AND pos < n - floor(n / 6) * 5 + (fold + 1) * floor(n / 6)),
fm AS (SELECT model, fold, avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse,
              avg(abs(y - p)) AS mae, 1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0) AS r2 FROM tf GROUP BY model, fold)"""


@register("cv_summary", _CV_SQL + f"""
SELECT model, {", ".join(f"{rnd_expr(f'avg({m})')} AS {m}_mean, {rnd_expr(f'stddev_pop({m})')} AS {m}_std"
                        for m in ("mse", "rmse", "mae", "r2"))} FROM fm GROUP BY model""", ids="M7")
def q_cv_summary(spark, d):
    return finalize(M.cv_summary(_fold_metrics(spark, d)))


@register("cv_score", _CV_SQL + f"""
SELECT model, {rnd_expr('avg(mse)')} AS mse_mean, {rnd_expr('stddev_pop(mse)')} AS mse_std,
       {rnd_expr('sqrt(avg(mse))')} AS rmse, {rnd_expr('sqrt(stddev_pop(mse))')} AS rmse_std FROM fm GROUP BY model""",
          ids="M8")
def q_cv_score(spark, d):
    return finalize(M.cv_score(_fold_metrics(spark, d)))


@register("best_so_far", _CV_SQL + f""",
t AS (SELECT row_number() OVER (ORDER BY model, fold) - 1 AS trial, mse FROM fm)
SELECT trial, {rnd_expr('mse')} AS score, {rnd_expr('min(mse) OVER (ORDER BY trial)')} AS best_so_far FROM t""", ids="E12")
def q_best_so_far(spark, d):
    """Fold scores as trials, in the order of model and fold."""
    from barlake.operators.ensemble import best_so_far
    order = Window.partitionBy(F.lit(0)).orderBy("model", "fold")  # models x folds rows
    trials = _fold_metrics(spark, d).select((F.row_number().over(order) - 1).alias("trial"), F.col("mse").alias("score"))
    return finalize(best_so_far(trials))


_HISTORY_SQL = PRED_SQL + """,
h AS (SELECT model, CASE WHEN date < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'val' END AS part,
             avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae FROM preds GROUP BY 1, 2)"""


def _rule_history(spark, d):
    part = F.when(F.col("date") < F.lit("2024-01-20").cast("timestamp_ntz"), "train").otherwise("val")
    long = M.fold_metrics(long_predictions(spark, d).withColumn("part", part), by=("model", "part"))
    wide = long.groupBy("model").pivot("part", ["train", "val"]).agg(F.first("mse").alias("mse"), F.first("mae").alias("mae"))
    return wide.withColumn("status", F.lit("ok"))


@register("training_summary", _HISTORY_SQL + f"""
SELECT model, {", ".join(f"{rnd_expr(f'max(CASE WHEN part = {chr(39)}{q}{chr(39)} THEN {m} END)')} AS {q}_{m}" for q in ("train", "val") for m in ("mse", "mae"))}
FROM h GROUP BY model""", ids="E9")
def q_training_summary(spark, d):
    from barlake.operators.ensemble import training_summary
    return finalize(training_summary(_rule_history(spark, d)))


@register("best_model", _HISTORY_SQL + f"""
SELECT model, {rnd_expr('mae')} AS val_mae FROM h WHERE part = 'val' ORDER BY mae, model LIMIT 1""", ids="E8")
def q_best_model(spark, d):
    from barlake.operators.ensemble import best_model
    return finalize(best_model(_rule_history(spark, d), "mae").select("model", "val_mae"))


def _fold_metrics(spark, d):
    blocks = M.expanding_blocks(long_predictions(spark, d), out="fold", by=("model",))
    return M.fold_metrics(blocks.where("fold >= 0"))


def _hash_sql(seed):
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', stock_code, CAST(date AS VARCHAR))), 1, 8))::BIGINT"


@register("random_split", with_bars() + f"""
SELECT CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2 + 0.1 THEN 'val' ELSE 'train' END AS split, count(*) AS n
FROM (SELECT ({_hash_sql(42)} % 1000000) / 1e6 AS u FROM clean) GROUP BY 1""", ids="M2")
def q_random_split(spark, d):
    out = M.random_split(clean_panel(spark, d).select("stock_code", "date"))
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("shuffled_folds", with_bars() + f"""
SELECT ({_hash_sql(43)} % 5)::INTEGER AS fold, count(*) AS n FROM clean GROUP BY 1""", ids="M3")
def q_shuffled_folds(spark, d):
    out = M.shuffled_folds(clean_panel(spark, d).select("stock_code", "date"))
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
