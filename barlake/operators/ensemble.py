"""Model ensembles and training management.

Base models are independent Spark jobs, so they are fit concurrently from a
driver thread pool (each fit is itself distributed). Out-of-fold and hold-out
predictions are DataFrames; only model parameters reach the driver. The training rows, with
their folds, are written once; every fit and every prediction reads a filter on that table.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.operators import models as M
from barlake.operators import splits as S
from barlake.functions.windows import KEY, TIME
from barlake.session import written

DEFAULT_BASES = ("xgboost", "lightgbm", "ridge")


def _fit_many(jobs: dict, features, label, workers: int = 8, **kw) -> dict:
    """job -> (preset, stored training rows); the fits share nothing but the table they read."""
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(jobs)))) as pool:
        found = {job: pool.submit(M.fit, name, rows, features, label, stored=True, **kw) for job, (name, rows) in jobs.items()}
        return {job: f.result() for job, f in found.items()}


def _predict_cols(models: dict, df: DataFrame, keep) -> DataFrame:
    out = df
    for i, (n, m) in enumerate(models.items()):
        out = M.predict(m, out, f"m{i}_pred", keep=list(out.columns))
    return out.select(*keep, *[f"m{i}_pred" for i in range(len(models))])


class Ensemble:
    """Fitted ensemble: base models + combination rule (+ meta model)."""

    def __init__(self, method, bases: dict, meta=None, weights=None):
        self.method, self.bases, self.meta, self.weights = method, bases, meta, weights

    def predict(self, df: DataFrame, out: str = "predicted_return") -> DataFrame:
        keep = list(df.columns)
        cols = _predict_cols(self.bases, df, keep)
        names = [f"m{i}_pred" for i in range(len(self.bases))]
        if self.meta is not None:
            return M.predict(self.meta, cols, out, keep=keep)
        w = self.weights or [1.0] * len(names)
        num = sum((F.col(c) * wi for c, wi in zip(names, w)), F.lit(0.0))
        return cols.withColumn(out, num / float(sum(w))).select(*keep, out)


def _rows(df, features, label) -> DataFrame:
    return M.training_frame(df, features, label).select(*dict.fromkeys([KEY, TIME, *features, label]))


def voting(df, features, label, bases=DEFAULT_BASES, weights=None) -> Ensemble:
    """Unweighted (or weighted) mean of refitted base models."""
    data = written(_rows(df, features, label), "voting")
    return Ensemble("voting", _fit_many({n: (n, data) for n in bases}, features, label), weights=weights)


def stacking(df, features, label, bases=DEFAULT_BASES, k: int = 5, workers: int = 8) -> Ensemble:
    """E5: out-of-fold base predictions on k contiguous folds → ridge meta model;
    bases are then refit on all rows. All k·|bases| + |bases| fits are
    independent and run concurrently."""
    folded = written(S.contiguous_folds(written(_rows(df, features, label), "rows"), k), "folds")
    jobs = {(f, n): (n, folded if f is None else folded.where(F.col("fold") != f)) for f in (*range(k), None) for n in bases}
    fitted = _fit_many(jobs, features, label, workers)
    oof = None
    for f in range(k):
        te = folded.where(F.col("fold") == f)
        part = _predict_cols({n: fitted[(f, n)] for n in bases}, te, [KEY, TIME, label])
        oof = part if oof is None else oof.unionByName(part)
    meta = M.fit("ridge", oof, [f"m{i}_pred" for i in range(len(bases))], label)
    return Ensemble("stacking", {n: fitted[(None, n)] for n in bases}, meta=meta)


def blending(df, features, label, bases=DEFAULT_BASES, holdout: float = 0.2, workers: int = 8) -> Ensemble:
    """Bases fit on the first 80 % (time order), ridge meta on the last 20 %,
    bases refit on everything (all base fits concurrent). Predicts like stacking."""
    split = written(S.holdout_tail(written(_rows(df, features, label), "rows"), 1 - holdout), "blending")
    jobs = {(part, n): (n, rows) for part, rows in (("base", split.where("split = 'base'")), ("all", split)) for n in bases}
    fitted = _fit_many(jobs, features, label, workers)
    hold = _predict_cols({n: fitted[("base", n)] for n in bases}, split.where("split = 'meta'"), [KEY, TIME, label])
    meta = M.fit("ridge", hold, [f"m{i}_pred" for i in range(len(bases))], label)
    return Ensemble("blending", {n: fitted[("all", n)] for n in bases}, meta=meta)


def train_many(df, features, label, names, split_col: str = "split", workers: int = 4, **kw):
    """Fit every named model on 'train' rows, score 'train' and 'val';
    failures are recorded with their text and skipped. Boosters stop early on the 'val' rows and
    record their rounds. Returns (models, history DataFrame)."""
    data = written(df.select(*dict.fromkeys([*features, label, split_col])), "train-many")
    train = data.where(F.col(split_col) == "train")
    val = data.where(F.col(split_col) == "val")

    def one(name):
        t0 = time.time()
        try:
            m = M.fit(name, train, features, label, stored=True, validation=val, **kw)
        except Exception as e:  # noqa: BLE001 - failing models are skipped
            return name, None, {"model": name, "status": f"failed: {type(e).__name__}: {str(e)[:200]}"}
        row = {"model": name, "status": "ok", "training_time": time.time() - t0, "n_features": len(features),
               "rounds": m.extra.get("rounds")}
        for part, frame in (("train", train), ("val", val)):
            for k, v in M.metrics(M.predict(m, frame, keep=[label]), label).items():
                row[f"{part}_{k}"] = v
        return name, m, row

    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(names)))) as pool:
        results = list(pool.map(one, names))
    models = {n: m for n, m, _ in results if m is not None}
    spark = df.sparkSession
    keys = ["model", "status", "training_time", "n_features", "rounds"] + [f"{p}_{k}" for p in ("train", "val")
                                                                         for k in ("mse", "rmse", "mae", "r2")]
    rows = [tuple(r.get(k) for k in keys) for _, _, r in results]
    schema = ("model string, status string, training_time double, n_features int, rounds int, "
              + ", ".join(f"{p}_{k} double" for p in ("train", "val") for k in ("mse", "rmse", "mae", "r2")))
    return models, spark.createDataFrame(rows, schema)


def best_model(history: DataFrame, metric: str = "rmse") -> DataFrame:
    """Min for error metrics, max otherwise; validation preferred over train."""
    col = f"val_{metric}" if f"val_{metric}" in history.columns else f"train_{metric}"
    asc = metric in ("mse", "rmse", "mae")
    order = F.col(col).asc_nulls_last() if asc else F.col(col).desc_nulls_last()
    return history.where("status = 'ok'").orderBy(order, "model").limit(1)


def training_summary(history: DataFrame) -> DataFrame:
    """One row per model with train_* / val_* columns (long → pivot)."""
    metric_cols = [c for c in history.columns if c.startswith(("train_", "val_"))]
    long = history.unpivot(["model"], metric_cols, "metric", "value")
    return long.groupBy("model").pivot("metric", metric_cols).agg(F.first("value"))


def best_so_far(trials: DataFrame, score: str = "score", trial: str = "trial") -> DataFrame:
    """Running minimum of the trial scores (small table: one row per trial)."""
    w = Window.partitionBy(F.lit(0)).orderBy(trial).rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best_so_far", F.min(score).over(w))
