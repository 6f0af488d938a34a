"""Regressors on an assembled bar-feature panel with Spark ML.

Every model is a ``pyspark.ml`` Pipeline (VectorAssembler → [scaler] →
regressor) fit on the executors; only model parameters (trees, coefficient
vectors, p×p Gram matrices) come back to the driver.

Presets follow the reference's defaults. Where Spark's estimator differs
from the reference library the preset says so:

* booster variants (level-wise, leaf-wise, symmetric) all map to ``GBTRegressor``;
  leaf-wise growth with 31 leaves is approximated by depth 5;
* extremely randomised trees map to a non-bootstrapped random forest with a
  feature subset of all (split points are optimal, not random);
* linear models standardise features with the *population* deviation (the
  reference's scaler), then solve with the normal equations; ridge / elastic
  net penalties are converted to Spark's parametrisation (label-scaled);
* Bayesian ridge runs evidence maximisation on the driver over a Gram matrix
  aggregated in one Spark pass;
* AdaBoost.R2 reweights rows (``weightCol``) instead of resampling them.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressionModel, GBTRegressor,
                                   LinearRegression, RandomForestRegressor)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.operators.clean import fit_standard
from barlake.session import discard, written

SEED = 42
LABEL = "label"
PRED = "prediction"

# Model presets (reference defaults).
PRESETS = {
    "xgboost": dict(kind="gbt", maxIter=100, maxDepth=6, stepSize=0.1, subsamplingRate=0.8,
                    featureSubsetStrategy="0.8"),
    "lightgbm": dict(kind="gbt", maxIter=100, maxDepth=5, stepSize=0.1, subsamplingRate=1.0,
                     featureSubsetStrategy="all"),
    "catboost": dict(kind="gbt", maxIter=100, maxDepth=6, stepSize=0.1, subsamplingRate=1.0,
                     featureSubsetStrategy="all"),
    # depth is a parameter of every tree family: fit(..., maxDepth=d), up to Spark's ceiling of 30
    "extra_trees": dict(kind="rf", numTrees=100, bootstrap=False, featureSubsetStrategy="all",
                        maxDepth=10),
    "random_forest": dict(kind="rf", numTrees=100, bootstrap=True, featureSubsetStrategy="all",
                          maxDepth=10),
    "bagging": dict(kind="rf", numTrees=10, bootstrap=True, featureSubsetStrategy="all",
                    subsamplingRate=1.0, maxDepth=10),
    "linear": dict(kind="linear"),
    "ridge": dict(kind="ridge", alpha=1.0),
    "lasso": dict(kind="lasso", alpha=1.0, maxIter=1000),
    "elastic_net": dict(kind="elastic_net", alpha=1.0, l1_ratio=0.5, maxIter=1000),
    "polynomial": dict(kind="polynomial", degree=2, alpha=1.0),
    "bayesian_ridge": dict(kind="bayes", max_iter=300, tol=1e-3, alpha_1=1e-6, alpha_2=1e-6,
                           lambda_1=1e-6, lambda_2=1e-6),
    "adaboost": dict(kind="adaboost", n_estimators=50, learning_rate=1.0, maxDepth=3),
}


class FittedModel:
    """A fitted model: Spark PipelineModel (or driver-side coefficients) plus
    the feature list and the population-std scaler it was trained with."""

    def __init__(self, name, features, pipeline=None, scaler=None, extra=None):
        self.name = name
        self.features = list(features)
        self.pipeline: PipelineModel | None = pipeline
        self.scaler = scaler          # {feature: (mean, std)} or None
        self.extra = extra or {}      # driver-side parameters (Bayes, AdaBoost)

    # -- scoring ------------------------------------------------------------------
    def _scaled(self, df: DataFrame) -> DataFrame:
        if not self.scaler:
            return df
        out = {}
        for c, (m, s) in self.scaler.items():
            out[c] = (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0)
        return df.withColumns(out)

    def transform(self, df: DataFrame) -> DataFrame:
        kind = PRESETS.get(self.name, {}).get("kind", self.extra.get("kind"))
        if kind == "bayes":
            return _bayes_predict(self, df)
        if kind == "adaboost":
            return _ada_predict(self, df)
        return self.pipeline.transform(self._scaled(df))

    # -- persistence (G16) ------------------------------------------------------------
    def save(self, spark, path: str) -> None:
        extra = {k: v for k, v in self.extra.items() if k != "trees"}  # tree models are saved beside
        meta = {"name": self.name, "features": self.features, "scaler": self.scaler, "extra": extra,
                "pipeline": self.pipeline is not None}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/meta")
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(f"{path}/pipeline")
        if self.extra.get("trees"):
            for i, t in enumerate(self.extra["trees"]):
                t.write().overwrite().save(f"{path}/tree_{i}")

    @staticmethod
    def load(spark, path: str) -> "FittedModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        extra = meta.get("extra") or {}
        pipe = PipelineModel.load(f"{path}/pipeline") if meta["pipeline"] else None
        if extra.get("kind") == "adaboost":
            from pyspark.ml.regression import DecisionTreeRegressionModel
            extra["trees"] = [DecisionTreeRegressionModel.load(f"{path}/tree_{i}")
                              for i in range(len(extra.get("weights", [])))]
        scaler = {k: tuple(v) for k, v in (meta.get("scaler") or {}).items()} or None
        return FittedModel(meta["name"], meta["features"], pipe, scaler, extra)


def latest_run(spark, root: str, name: str) -> str | None:
    """Newest ``root/name/<run_id>`` directory (run ids sort by time)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    runs = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    return f"{root.rstrip('/')}/{name}/{runs[-1]}" if runs else None


# -- training ------------------------------------------------------------------------------

def training_frame(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows with a complete feature vector and label (the reference drops NaN rows)."""
    return df.na.drop(subset=list(features) + [label]).withColumn(LABEL, F.col(label).cast("double"))


def _assembler(features):
    return VectorAssembler(inputCols=list(features), outputCol="features")


def _label_std(df: DataFrame) -> tuple[float, int]:
    r = df.agg(F.stddev_pop(LABEL), F.count(F.lit(1))).first()
    return float(r[0] or 0.0), int(r[1])


def fit(name: str, df: DataFrame, features: list[str], label: str = "target_return_1d",
        seed: int = SEED, weight_col: str | None = None, validation: DataFrame | None = None, patience: int = 50,
        stored: bool = False, rows_per_partition: int = 250_000, **overrides) -> FittedModel:
    """Fit preset ``name`` (G1-G12) on ``df``; ``overrides`` patch the preset.

    The training rows are written once for the passes of the fit and deleted after it;
    ``stored=True`` says that ``df`` already is a filter on such a table, which several fits may
    read at once. ``rows_per_partition`` sizes the tasks of the learners' many small jobs (forests
    draw their samples by partition, so their trees depend on it).

    With ``validation`` rows a booster keeps only the rounds up to its least validation error, the
    search ending ``patience`` rounds after it (G1, G2): see ``extra["rounds"]``."""
    more = [weight_col] if weight_col else []
    data = training_frame(df, features, label).select(*dict.fromkeys([*features, LABEL, *more]))
    table = None if stored else written(data, "training")
    try:
        data = data if stored else table
        target = max(1, -(-data.count() // rows_per_partition))
        fit_data = data.coalesce(target) if target < data.rdd.getNumPartitions() else data
        model = _fit(name, fit_data, features, seed, weight_col, overrides)
    finally:
        discard(table)
    if validation is not None and PRESETS[name]["kind"] == "gbt":
        _stop_early(model, training_frame(validation, features, label), patience)
    return model


def stopping_round(errors: list[float], patience: int) -> int:
    """Rounds kept: up to the least error seen before `patience` rounds pass without a lesser one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def _stop_early(model: FittedModel, validation: DataFrame, patience: int) -> None:
    """One pass over the validation rows gives the error after every round."""
    assembler, trees = model.pipeline.stages
    errors = trees.evaluateEachIteration(assembler.transform(validation), "squared")
    rounds = stopping_round(errors, patience)
    model.extra |= {"rounds": rounds, "validation_errors": [float(e) for e in errors]}
    if rounds < trees.getNumTrees:
        sc = _spark().sparkContext
        package = sc._jvm.org.apache.spark.ml.regression
        kept = sc._gateway.new_array(package.DecisionTreeRegressionModel, rounds)
        weights = sc._gateway.new_array(sc._jvm.double, rounds)
        for i in range(rounds):
            kept[i], weights[i] = trees._java_obj.trees()[i], float(trees.treeWeights[i])
        short = GBTRegressionModel(package.GBTRegressionModel(trees.uid, kept, weights, trees.numFeatures))
        model.pipeline = PipelineModel([assembler, short.setFeaturesCol("features")])


def _fit(name, data, features, seed, weight_col, overrides) -> FittedModel:
    cfg = {**PRESETS[name], **overrides}
    kind = cfg.pop("kind")
    if kind == "gbt":
        est = GBTRegressor(featuresCol="features", labelCol=LABEL, seed=seed, **cfg)
        if weight_col:
            est = est.setWeightCol(weight_col)
        return FittedModel(name, features, Pipeline(stages=[_assembler(features), est]).fit(data))
    if kind == "rf":
        est = RandomForestRegressor(featuresCol="features", labelCol=LABEL, seed=seed, **cfg)
        return FittedModel(name, features, Pipeline(stages=[_assembler(features), est]).fit(data))
    if kind == "adaboost":
        return _ada_fit(name, data, features, cfg, seed)
    if kind == "polynomial":
        # expand the raw features, standardise, ridge. The scaler divides by the sample deviation;
        # (n - 1) / n in the penalty makes that the fit on population-standardised terms
        sy, n = _label_std(data)
        stages = [_assembler(features), PolynomialExpansion(degree=cfg["degree"], inputCol="features", outputCol="poly"),
                  StandardScaler(inputCol="poly", outputCol="poly_s", withMean=True, withStd=True),
                  LinearRegression(featuresCol="poly_s", labelCol=LABEL, solver="normal", standardization=False,
                                   regParam=cfg["alpha"] * sy / max(n, 1) * max(n - 1, 1) / max(n, 1))]
        return FittedModel(name, features, Pipeline(stages=stages).fit(data))
    # linear family on population-standardised features
    stats = fit_standard(data, features).first()
    scaler = {c: (float(stats[c]["m"]), float(stats[c]["s"] or 1.0) or 1.0) for c in features}
    model = FittedModel(name, features, None, scaler)
    scaled = model._scaled(data)
    if kind == "bayes":  # one shared prior: only comparable on standardised features
        return _bayes_fit(name, scaled, features, cfg, scaler)
    sy, n = _label_std(data)
    if kind == "linear":
        lr = LinearRegression(regParam=0.0, solver="normal", standardization=False)
    elif kind == "ridge":
        lr = LinearRegression(regParam=cfg["alpha"] * sy / max(n, 1), elasticNetParam=0.0,
                              solver="normal", standardization=False)
    elif kind == "lasso":
        lr = LinearRegression(regParam=cfg["alpha"], elasticNetParam=1.0, maxIter=cfg["maxIter"],
                              standardization=False)
    elif kind == "elastic_net":
        a, l1 = cfg["alpha"], cfg["l1_ratio"]
        reg = a * l1 + a * (1 - l1) * sy
        lr = LinearRegression(regParam=reg, elasticNetParam=(a * l1 / reg) if reg else 0.0,
                              maxIter=cfg["maxIter"], standardization=False)
    else:
        raise ValueError(f"unknown model kind {kind}")
    lr = lr.setFeaturesCol("features").setLabelCol(LABEL)
    if weight_col:
        lr = lr.setWeightCol(weight_col)
    model.pipeline = Pipeline(stages=[_assembler(features), lr]).fit(scaled)
    return model


def predict(model: FittedModel, df: DataFrame, out: str = "predicted_return", keep=None) -> DataFrame:
    """Score rows; rows with a missing feature are scored with nulls → 0 (P12). The columns that are
    kept (by default all) keep their values: scaled features are the model's own business."""
    cols = [c for c in (keep if keep is not None else df.columns) if c != out]
    data = df.withColumn("_kept", F.struct(*cols)).na.fill(0.0, subset=model.features)
    return model.transform(data).select("_kept.*", F.col(PRED).alias(out))


def importances(model: FittedModel) -> DataFrame:
    """Tree importances or |coefficients|, sorted descending."""
    spark = _spark()
    last = model.pipeline.stages[-1] if model.pipeline is not None else None
    if last is not None and hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
        names = model.features
    elif last is not None and hasattr(last, "coefficients"):
        vals = [abs(v) for v in last.coefficients.toArray().tolist()]
        names = model.features if len(vals) == len(model.features) else [f"poly_{i}" for i in range(len(vals))]
    elif "coef" in model.extra:
        vals = [abs(v) for v in model.extra["coef"]]
        names = model.features
    else:
        vals = list(model.extra.get("importances", [0.0] * len(model.features)))
        names = model.features
    df = spark.createDataFrame(list(zip(names, [float(v) for v in vals])), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature")


def _spark():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def metrics(pred: DataFrame, label: str = "target_return_1d", p: str = "predicted_return") -> dict:
    """mse, rmse, mae, r2 in one aggregate (one row to the driver)."""
    e = F.col(label) - F.col(p)
    r = pred.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(label).alias("vy")).first()
    mse = float(r["mse"]) if r["mse"] is not None else float("nan")
    vy = float(r["vy"] or 0.0)
    return {"mse": mse, "rmse": math.sqrt(mse) if mse == mse else mse, "mae": float(r["mae"] or 0.0),
            "r2": 1 - mse / vy if vy else float("nan")}


# -- Bayesian ridge (G9, U4) ------------------------------------------------------------------

def gram_stats(df: DataFrame, features: list[str], label: str = LABEL):
    """n, means, centred XᵀX, Xᵀy, yᵀy of complete rows: one pass, a row for each pair of
    columns and partition, whatever the number of features."""
    from barlake.functions.moments import cross_moments

    p = len(features)
    found, shift = cross_moments(df, [*features, label])
    n, total, cross = 0.0, np.zeros(p + 1), np.zeros((p + 1, p + 1))
    for r in found.collect():  # (p + 1)(p + 2) / 2 rows
        cross[r.i, r.j] = cross[r.j, r.i] = r.sxy
        if r.i == r.j:
            n, total[r.i] = r.n, r.sx
    centred = cross - np.outer(total, total) / max(n, 1.0)
    mean = shift + total / max(n, 1.0)
    return n, mean[:p], float(mean[p]), centred[:p, :p], centred[:p, p], float(centred[p, p])


def bayes_evidence(n, xx, xy, yy, max_iter=300, tol=1e-3, alpha_1=1e-6, alpha_2=1e-6,
                   lambda_1=1e-6, lambda_2=1e-6):
    """MacKay evidence maximisation on centred sufficient statistics."""
    eig, vec = np.linalg.eigh(xx)
    eig = np.clip(eig, 0.0, None)
    var_y = yy / n
    alpha = 1.0 / (var_y + np.finfo(float).eps)
    lam = 1.0
    coef_old = None
    proj = vec.T @ xy
    for _ in range(max_iter):
        coef = vec @ (proj / (eig + lam / alpha))
        rss = yy - 2 * coef @ xy + coef @ xx @ coef
        gamma = float(np.sum(alpha * eig / (lam + alpha * eig)))
        lam = (gamma + 2 * lambda_1) / (float(coef @ coef) + 2 * lambda_2)
        alpha = (n - gamma + 2 * alpha_1) / (max(rss, 0.0) + 2 * alpha_2)
        if coef_old is not None and np.sum(np.abs(coef_old - coef)) < tol:
            break
        coef_old = coef
    coef = vec @ (proj / (eig + lam / alpha))
    sigma = vec @ np.diag(1.0 / (alpha * eig + lam)) @ vec.T
    return coef, alpha, lam, sigma


def _bayes_fit(name, data, features, cfg, scaler) -> FittedModel:
    n, mx, my, xx, xy, yy = gram_stats(data, features)
    coef, alpha, lam, sigma = bayes_evidence(n, xx, xy, yy, **cfg)
    intercept = my - float(mx @ coef)
    extra = {"kind": "bayes", "coef": coef.tolist(), "intercept": intercept, "alpha": alpha,
             "lambda": lam, "sigma": sigma.tolist(), "x_mean": mx.tolist()}
    return FittedModel(name, features, None, scaler, extra)


def _bayes_predict(model: FittedModel, df: DataFrame) -> DataFrame:
    """Projection xᵀw + b and predictive std sqrt(1/α + (x-x̄)ᵀΣ(x-x̄)).

    Σ is p×p (bounded by the feature count) and travels inside the UDF
    closure; each Arrow batch is one numpy matrix product."""
    from pyspark.sql import types as T

    ex = model.extra
    w = np.asarray(ex["coef"], dtype=float)
    b = float(ex["intercept"])
    mu = np.asarray(ex["x_mean"], dtype=float)
    sig = np.asarray(ex["sigma"], dtype=float)
    inv_alpha = 1.0 / float(ex["alpha"])
    out_type = T.StructType([T.StructField(PRED, T.DoubleType()), T.StructField("uncertainty", T.DoubleType())])

    @F.pandas_udf(out_type)
    def score(x: pd.DataFrame) -> pd.DataFrame:
        m = x.to_numpy(dtype=float)
        c = m - mu
        quad = np.einsum("ij,jk,ik->i", c, sig, c)
        return pd.DataFrame({PRED: m @ w + b, "uncertainty": np.sqrt(np.clip(quad, 0.0, None) + inv_alpha)})

    def standard(c):
        m, s = model.scaler[c]
        return (F.col(c).cast("double") - F.lit(m)) / F.lit(s if s else 1.0)

    s = score(F.struct(*[standard(c).alias(f"x{i}") for i, c in enumerate(model.features)]))
    return df.withColumn("_bayes", s).withColumns({PRED: F.col("_bayes")[PRED],
                                                   "uncertainty": F.col("_bayes")["uncertainty"]}).drop("_bayes")


# -- AdaBoost.R2 (G12) --------------------------------------------------------------------------

def _ada_fit(name, data, features, cfg, seed) -> FittedModel:
    """Each round is one tree, one aggregate and one table of new weights, the former one deleted.

    Weights need not sum to one: errors are divided by their sum, and a round's weights by the
    sum of the round before."""
    n_est, lr_rate, depth = cfg["n_estimators"], cfg["learning_rate"], cfg["maxDepth"]
    cur = written(_assembler(features).transform(data).select("features", LABEL, F.lit(1.0).alias("_w")), "boosting")
    trees, weights = [], []
    try:
        for it in range(n_est):
            tree = DecisionTreeRegressor(featuresCol="features", labelCol=LABEL, weightCol="_w",
                                         maxDepth=depth, seed=seed + it).fit(cur)
            scored = tree.transform(cur).withColumn("_err", F.abs(F.col(LABEL) - F.col(PRED)))
            mx, lost, total = scored.agg(F.max("_err"), F.sum(F.col("_w") * F.col("_err")), F.sum("_w")).first()
            if not mx:
                trees.append(tree)
                weights.append(1.0)
                break
            est_err = lost / mx / total
            if est_err >= 0.5:
                if not trees:
                    trees.append(tree)
                    weights.append(1.0)
                break
            beta = est_err / (1.0 - est_err)
            trees.append(tree)
            weights.append(lr_rate * math.log(1.0 / beta) if beta > 0 else 1.0)
            new = F.col("_w") / total * F.pow(F.lit(beta), (1.0 - F.col("_err") / mx) * lr_rate)
            nxt = written(scored.select("features", LABEL, new.alias("_w")), "boosting")
            discard(cur)
            cur = nxt
    finally:
        discard(cur)
    imp = np.zeros(len(features))
    for t, w in zip(trees, weights):
        imp += w * t.featureImportances.toArray()
    if imp.sum() > 0:
        imp = imp / imp.sum()
    return FittedModel(name, features, None, None,
                       {"kind": "adaboost", "trees": trees, "weights": weights, "importances": imp.tolist()})


def _ada_predict(model: FittedModel, df: DataFrame) -> DataFrame:
    """Weighted median of the trees' predictions (Drucker's AdaBoost.R2)."""
    base = _assembler(model.features).transform(df)
    cols = []
    cur = base
    for i, t in enumerate(model.extra["trees"]):
        cur = t.setPredictionCol(f"_p{i}").transform(cur)
        cols.append(F.struct(F.col(f"_p{i}").alias("v"), F.lit(float(model.extra["weights"][i])).alias("w")))
    arr = F.array_sort(F.array(*cols))
    half = 0.5 * float(sum(model.extra["weights"]))
    cum = F.transform(arr, lambda x, i: F.aggregate(F.slice(arr, 1, i + 1), F.lit(0.0), lambda a, y: a + y["w"]))
    idx = F.array_position(F.transform(cum, lambda c: c >= half), True)
    out = cur.withColumn(PRED, F.element_at(arr, idx.cast("int"))["v"])
    return out.drop(*[f"_p{i}" for i in range(len(model.extra["trees"]))], "features")


# -- uncertainty (U1-U3) ---------------------------------------------------------------------------

def tree_spread(model: FittedModel, df: DataFrame, staged: bool = False, step: int = 10) -> DataFrame:
    """U3 (forests: mean/pop-std over trees) and U2 (boosting: over staged sums)."""
    last = model.pipeline.stages[-1]
    base = model.pipeline.stages[0].transform(df)
    cur = base
    names = []
    for i, t in enumerate(last.trees):
        cur = t.setPredictionCol(f"_t{i}").transform(cur)
        names.append(f"_t{i}")
    arr = F.array(*[F.col(c) for c in names])
    if staged:
        w = [float(x) for x in last.treeWeights]
        stages = list(range(step, len(names) + 1, step)) or [len(names)]
        sums = [sum((F.col(names[j]) * w[j] for j in range(k)), F.lit(0.0)) for k in stages]
        arr = F.array(*sums)
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)
    var = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(arr)
    out = cur.withColumns({"mean_prediction": mean, "uncertainty": F.sqrt(var)})
    return out.drop(*names, "features")


# -- model-based selection (L4-L6) ---------------------------------------------------------------------

def _score_table(names, vals, method, selected_names):
    spark = _spark()
    rows = [(n, float(v), method, n in selected_names) for n, v in zip(names, vals)]
    df = spark.createDataFrame(rows, "feature string, score double, method string, selected boolean")
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "feature")
    return df.withColumn("rank", F.row_number().over(w))


def _selection_frame(df: DataFrame, features, label) -> DataFrame:
    """Labelled rows, nulls of a feature replaced by its median: no row is lost to a missing feature."""
    from barlake.operators.clean import median_impute
    return median_impute(df.where(F.col(label).isNotNull()), list(features))


def importance_scores(df: DataFrame, features, label, threshold: float = 0.001, numTrees: int = 100) -> DataFrame:
    """Random-forest importance ≥ threshold, on median-imputed features."""
    df = _selection_frame(df, features, label)
    m = fit("random_forest", df, features, label, numTrees=numTrees)
    vals = m.pipeline.stages[-1].featureImportances.toArray()
    return _score_table(features, vals, "importance", {f for f, v in zip(features, vals) if v >= threshold})


def lasso_scores(df: DataFrame, features, label, alpha: float | None = None) -> DataFrame:
    """Non-zero lasso coefficients on the unscaled, median-imputed features; α from
    5-fold CV over a grid when None."""
    df = _selection_frame(df, features, label)
    if alpha is None:
        from pyspark.ml.evaluation import RegressionEvaluator
        from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
        data = training_frame(df, features, label)
        lr = LinearRegression(featuresCol="features", labelCol=LABEL, elasticNetParam=1.0, standardization=False)
        grid = ParamGridBuilder().addGrid(lr.regParam, [10 ** k for k in range(-6, 1)]).build()
        cv = CrossValidator(estimator=Pipeline(stages=[_assembler(features), lr]), estimatorParamMaps=grid,
                            evaluator=RegressionEvaluator(labelCol=LABEL, metricName="mse"),
                            numFolds=5, seed=SEED, parallelism=4)
        best = cv.fit(data)
        coefs = best.bestModel.stages[-1].coefficients.toArray()
    else:
        lr = LinearRegression(featuresCol="features", labelCol=LABEL, regParam=alpha, elasticNetParam=1.0, maxIter=1000,
                              standardization=False)
        fitted = Pipeline(stages=[_assembler(features), lr]).fit(training_frame(df, features, label))
        coefs = fitted.stages[-1].coefficients.toArray()
    vals = np.abs(coefs)
    return _score_table(features, vals, "lasso", {f for f, v in zip(features, vals) if v > 0})


def rfe_scores(df: DataFrame, features, label, n_features: int = 50, step: int = 1,
               numTrees: int = 100) -> DataFrame:
    """L4: refit a forest and drop the least important feature(s) until n remain.

    The feature frame is written once; each round is one forest fit.
    Score = elimination round (survivors rank best)."""
    data = written(training_frame(_selection_frame(df, features, label), features, label).select(*features, LABEL), "rfe")
    remaining = list(features)
    eliminated_at = {}
    rnd = 0
    while len(remaining) > max(n_features, 1):
        m = fit("random_forest", data, remaining, LABEL, numTrees=numTrees, stored=True)
        imp = m.pipeline.stages[-1].featureImportances.toArray()
        order = sorted(zip(imp, remaining))
        k = min(step, len(remaining) - max(n_features, 1))
        for _, f in order[:k]:
            eliminated_at[f] = rnd
            remaining.remove(f)
        rnd += 1
    discard(data)
    vals = [eliminated_at.get(f, rnd) for f in features]
    return _score_table(features, vals, "rfe", set(remaining))

