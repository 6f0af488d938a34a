"""Hyper-parameter search (E10-E12), re-aimed as seeded random search.

The reference's sequential TPE optimiser is a driver-side algorithm; here the
same search spaces are sampled with a seeded generator and each trial's
cross-validated score (sqrt of the mean fold MSE) is computed by Spark, with
trials running concurrently from a driver thread pool; ridge trials share the
folds' moments. Folds are expanding
time-series folds (M4) or seeded hash folds (M3).
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.moments import group_moments, merged_moments
from barlake.operators import models as M
from barlake.operators import splits as S
from barlake.session import written

# Search ranges per model family. Parameters that Spark ML has no counterpart
# for (reg_alpha, reg_lambda, l2_leaf_reg, num_leaves) are left out; colsample_bytree is
# featureSubsetStrategy, min_samples_leaf and min_samples_split bound minInstancesPerNode.
SPACES = {
    "xgboost": {"maxIter": ("int", 50, 500), "maxDepth": ("int", 3, 10), "stepSize": ("float", 0.01, 0.3),
                "subsamplingRate": ("float", 0.6, 1.0), "featureSubsetStrategy": ("share", 0.6, 1.0)},
    "lightgbm": {"maxIter": ("int", 50, 500), "maxDepth": ("int", 3, 15), "stepSize": ("float", 0.01, 0.3),
                 "subsamplingRate": ("float", 0.6, 1.0), "featureSubsetStrategy": ("share", 0.6, 1.0)},
    "catboost": {"maxIter": ("int", 50, 500), "maxDepth": ("int", 3, 10), "stepSize": ("float", 0.01, 0.3)},
    "ridge": {"alpha": ("float", 0.1, 100.0)},
    "lasso": {"alpha": ("float", 0.001, 10.0), "maxIter": ("int", 500, 2000)},
    "random_forest": {"numTrees": ("int", 50, 300), "maxDepth": ("int", 5, 20), "minInstancesPerNode": ("int", 1, 10),
                      "featureSubsetStrategy": ("choice", ["all", "sqrt", "log2"])},
}


def sample(space: dict, rng: random.Random) -> dict:
    out = {}
    for k, (kind, *between) in space.items():
        if kind == "choice":
            out[k] = rng.choice(between[0])
        elif kind == "int":
            out[k] = rng.randint(*between)
        else:
            out[k] = rng.uniform(*between)
            if kind == "share":  # Spark takes a share of the features as text
                out[k] = f"{out[k]:.3f}"
    return out


def cv_score(name: str, blocks: DataFrame, features, label, params: dict, k: int, time_series: bool) -> float:
    """sqrt(mean fold MSE); folds are filters on the ``_block`` column, never copies of the rows."""
    mses = []
    for f in range(k):
        past = F.col("_block") < f if time_series else F.col("_block") != f
        m = M.fit(name, blocks.where(past), features, label, stored=True, **params)
        mses.append(M.metrics(M.predict(m, blocks.where(F.col("_block") == f)), label)["mse"])
    return math.sqrt(sum(mses) / len(mses))


def ridge_scorer(blocks: DataFrame, features, label, k: int, time_series: bool):
    """:func:`cv_score` of a ridge as a function of its parameters, for any number of trials from two passes.

    The fit on standardised features, ``(Z'Z + alpha I) w = Z'y``, and the error on the rows of a fold
    need only rows, means and cross products of every fold: (features + 1)^2 numbers each."""
    found = group_moments(blocks, [*features, label], "_block")
    p, folds = len(features), []
    for f in range(k):
        n, mean, cross = merged_moments(g for b, g in found.items() if (b < f if time_series else b != f))
        if not np.isfinite(cross).all():
            raise ValueError("features and label must be finite")
        std = np.sqrt(np.diag(cross)[:p] / n)
        std[std <= 1e-14 * np.abs(mean[:p])] = 0.0  # rounding noise of a constant
        scale = np.where(std > 0, 1 / np.where(std > 0, std, 1.0), 0.0)  # a constant has no say
        eig, vec = np.linalg.eigh(cross[:p, :p] * np.outer(scale, scale))
        folds.append((mean, scale, np.clip(eig, 0.0, None), vec, vec.T @ (cross[:p, p] * scale), found.get(f)))

    def score(params: dict) -> float:
        alpha, mses = {**M.PRESETS["ridge"], **params}["alpha"], []
        for mean, scale, eig, vec, proj, test in folds:
            if test is None:
                return math.nan
            residual = np.append(-(vec @ (proj / (eig + alpha))) * scale, 1.0)
            n, at, cross = test
            mses.append(max(float(residual @ cross @ residual), 0.0) / n + float(residual @ (at - mean)) ** 2)
        return math.sqrt(sum(mses) / len(mses))
    return score


def random_search(name: str, df: DataFrame, features, label, n_trials: int = 100, k: int = 5,
                  seed: int = 42, time_series: bool = False, workers: int = 8) -> DataFrame:
    """E10 + E12: trial history ``(trial, model, params, score, error, best_so_far)`` (n_trials rows).

    Shuffled folds by default; ``time_series`` tests each of k blocks at the end on all rows before it."""
    data = written(M.training_frame(df, features, label).drop(M.LABEL), "search-rows")
    blocks = S.expanding_blocks(data, k, out="_block") if time_series else S.shuffled_folds(data, k, out="_block")
    blocks = written(blocks, "search-folds")
    rng = random.Random(seed)
    trials = [sample(SPACES[name], rng) for _ in range(n_trials)]

    def tried(params):
        return cv_score(name, blocks, features, label, params, k, time_series)

    if name == "ridge":  # a closed form: the trials share the passes over the rows
        try:
            tried = ridge_scorer(blocks, features, label, k, time_series)
        except ValueError:  # rows that cannot be fitted: every trial says so itself
            pass

    def run(i_params):
        i, params = i_params
        try:
            return i, params, tried(params), None
        except Exception as e:  # noqa: BLE001 - a failing trial scores null and keeps its error
            return i, params, None, f"{type(e).__name__}: {str(e)[:200]}"

    with ThreadPoolExecutor(max_workers=workers) as pool:
        rows = list(pool.map(run, enumerate(trials)))
    spark = df.sparkSession
    hist = spark.createDataFrame(
        [(i, name, {k2: str(v) for k2, v in p.items()}, s, e) for i, p, s, e in rows],
        "trial int, model string, params map<string,string>, score double, error string")
    from barlake.operators.ensemble import best_so_far
    return best_so_far(hist)


def search_many(names, df, features, label, **kw) -> DataFrame:
    """Search several families; one that cannot be searched is a row with its error."""
    out = None
    for n in names:
        try:
            h = random_search(n, df, features, label, **kw)
        except Exception as e:  # noqa: BLE001 - the other families are still searched
            h = df.sparkSession.createDataFrame(
                [(-1, n, {}, None, f"{type(e).__name__}: {str(e)[:200]}", None)],
                "trial int, model string, params map<string,string>, score double, error string, best_so_far double")
        out = h if out is None else out.unionByName(h)
    return out


def best_of_families(history: DataFrame) -> DataFrame:
    """Each family's best trial, ranked by its score (ties: smaller trial; families without a score last)."""
    best = Window.partitionBy("model").orderBy(F.col("score").asc_nulls_last(), "trial")
    ranked = history.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("score").asc_nulls_last(), "model")  # one row a family
    return ranked.select("model", "trial", "params", "score", "error", F.row_number().over(order).alias("rank"))


def flatten_params(history: DataFrame) -> DataFrame:
    """One column per parameter (``params.<name>``)."""
    keys = sorted({k for r in history.select(F.map_keys("params")).collect() for k in (r[0] or [])})
    return history.select("trial", "model", "score", "best_so_far",
                          *[F.col("params")[k].alias(f"params_{k}") for k in keys])
