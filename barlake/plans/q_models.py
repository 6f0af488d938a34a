"""Catalog: Spark ML models, uncertainty, ensembles, tuning, model-based selection.

Training data: the selection feature frame (events panel, 10 window features,
label = next-bar return) split in time order (M1). Models fit on 'train'
rows and score 'test' rows. Rows-only checks here; unit tests check recovery
of planted coefficients and the closed forms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import ensemble as E
from barlake.operators import models as M
from barlake.operators import splits as S
from barlake.operators import tuning as TU
from barlake.plans.catalog import register
from barlake.plans.common import finalize, rnd_expr
from barlake.plans.q_select import FEATURES, LABEL, SEL_SQL, selection_frame
from barlake.session import scratch_path

KEEP = ["stock_code", "date", LABEL]


def split_frame(spark, d):
    return S.time_split(selection_frame(spark, d))


def _model_query(name):
    def build(spark, d):
        sp = split_frame(spark, d)
        m = M.fit(name, sp.where("split = 'train'"), FEATURES, LABEL, validation=sp.where("split = 'val'"))
        return finalize(M.predict(m, sp.where("split = 'test'"), keep=KEEP), overrides={LABEL: 4, "predicted_return": 4})
    return build


for _name, _ids in (("linear", "G5"), ("ridge", "G6"), ("lasso", "G7"), ("elastic_net", "G8"),
                    ("bayesian_ridge", "G9 U4"), ("polynomial", "G10"), ("xgboost", "G1"),
                    ("lightgbm", "G2"), ("catboost", "G3"), ("extra_trees", "G4"), ("bagging", "G11"),
                    ("adaboost", "G12")):
    register(f"model_{_name}", None, check="ROWS", ids=_ids)(_model_query(_name))


@register("linear_one_feature", SEL_SQL + f""",
fit AS (SELECT regr_slope({LABEL}, return_1d) AS b, regr_intercept({LABEL}, return_1d) AS a
        FROM sel WHERE return_1d IS NOT NULL)
SELECT stock_code, date, {rnd_expr('a + b * coalesce(return_1d, 0)', 4)} AS predicted_return FROM sel, fit""",
          ids="G5 (one feature, closed form)")
def q_linear_one(spark, d):
    sf = selection_frame(spark, d)
    m = M.fit("linear", sf, ["return_1d"], LABEL)
    return finalize(M.predict(m, sf, keep=["stock_code", "date"]), overrides={"predicted_return": 4})


@register("feature_importance", None, check="ROWS", ids="G14")
def q_importance(spark, d):
    sp = split_frame(spark, d)
    return finalize(M.importances(M.fit("extra_trees", sp.where("split = 'train'"), FEATURES, LABEL)))


@register("uncertainty_trees", None, check="ROWS", ids="U3")
def q_unc_trees(spark, d):
    sp = split_frame(spark, d)
    m = M.fit("bagging", sp.where("split = 'train'"), FEATURES, LABEL)
    out = M.tree_spread(m, sp.where("split = 'test'").na.fill(0.0, subset=FEATURES))
    return finalize(out.select(*KEEP, "mean_prediction", "uncertainty"))


@register("uncertainty_staged", None, check="ROWS", ids="U2")
def q_unc_staged(spark, d):
    sp = split_frame(spark, d)
    m = M.fit("lightgbm", sp.where("split = 'train'"), FEATURES, LABEL)
    out = M.tree_spread(m, sp.where("split = 'test'").na.fill(0.0, subset=FEATURES), staged=True)
    return finalize(out.select(*KEEP, "mean_prediction", "uncertainty"))


def _ens(kind):
    def build(spark, d):
        sp = split_frame(spark, d)
        train = sp.where("split = 'train'")
        ens = {"voting": E.voting, "stacking": E.stacking, "blending": E.blending}[kind](train, FEATURES, LABEL)
        return finalize(ens.predict(sp.where("split = 'test'").select(*KEEP, *FEATURES)).select(*KEEP, "predicted_return"))
    return build


register("ensemble_voting", None, check="ROWS", ids="E4")(_ens("voting"))
register("ensemble_stacking", None, check="ROWS", ids="E5")(_ens("stacking"))
register("ensemble_blending", None, check="ROWS", ids="E6")(_ens("blending"))


@register("training_history", None, check="ROWS", ids="E7 E8 E9")
def q_training(spark, d):
    sp = split_frame(spark, d)
    _, hist = E.train_many(sp, FEATURES, LABEL, ["linear", "ridge", "lasso", "bayesian_ridge", "extra_trees", "lightgbm"])
    best = E.best_model(hist).select("model").withColumnRenamed("model", "best")
    summary = E.training_summary(hist)
    return finalize(summary.join(best, summary.model == best.best, "left")
                    .withColumn("is_best", F.col("best").isNotNull()).drop("best"))


@register("random_search", None, check="ROWS", ids="E10 E12")
def q_random_search(spark, d):
    sp = split_frame(spark, d).where("split != 'test'")
    return finalize(TU.flatten_params(TU.random_search("ridge", sp, FEATURES, LABEL)))


@register("search_families", None, check="ROWS", ids="E11")
def q_search_families(spark, d):
    sp = split_frame(spark, d).where("split != 'test'")
    found = TU.search_many(["ridge", "lasso"], sp, FEATURES, LABEL, n_trials=8, time_series=True)
    return finalize(TU.best_of_families(found).withColumn("params", F.to_json("params")))


@register("rfe_select", None, check="ROWS", ids="L4")
def q_rfe(spark, d):
    return finalize(M.rfe_scores(selection_frame(spark, d), FEATURES, LABEL, n_features=5))


@register("lasso_select", None, check="ROWS", ids="L5")
def q_lasso_select(spark, d):
    return finalize(M.lasso_scores(selection_frame(spark, d), FEATURES, LABEL))


@register("importance_select", None, check="ROWS", ids="L6")
def q_importance_select(spark, d):
    return finalize(M.importance_scores(selection_frame(spark, d), FEATURES, LABEL))


@register("model_roundtrip", None, check="ROWS", ids="G15 G16")
def q_roundtrip(spark, d):
    """Fit, save under the shared checkpoint folder, reload, rescore; the
    result pairs both predictions (they must be equal)."""
    import time
    sp = split_frame(spark, d)
    m = M.fit("ridge", sp.where("split = 'train'"), FEATURES, LABEL, alpha=0.5)
    path = scratch_path(spark, f"models/ridge/{int(time.time() * 1000)}")
    m.save(spark, path)
    back = M.FittedModel.load(spark, M.latest_run(spark, path.rsplit("/", 2)[0], "ridge"))
    test = sp.where("split = 'test'")
    a = M.predict(m, test, "p_saved", keep=KEEP)
    b = M.predict(back, test, "p_loaded", keep=["stock_code", "date"])
    return finalize(a.join(b, ["stock_code", "date"]))
