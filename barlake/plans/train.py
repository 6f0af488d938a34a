"""Training plan (reference entry point 2): features → projection by rule →
selection → time split → fit many → best model → save."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from barlake.operators import clean, ensemble, selection, splits
from barlake.operators.registry import apply_features


def build_training_frame(bars: DataFrame, groups=("price", "volume", "sma", "bollinger", "kdj", "lags")):
    feats_df, _ = apply_features(bars, list(groups))
    labelled = splits.next_return_label(feats_df)
    feats = clean.feature_columns(labelled, target="target_return_1d",
                                  exclude_prefixes=("target_",), keys=("stock_code", "date", "amount"))
    return labelled, feats


def train(bars: DataFrame, models=("linear", "ridge", "bayesian_ridge"), method: str = "correlation",
          save_root: str | None = None, **select_kw):
    """Returns (best name, fitted models, history, selected features)."""
    frame, feats = build_training_frame(bars)
    frame = frame.where("target_return_1d IS NOT NULL")
    chosen, _ = selection.select_features(frame, feats, "target_return_1d", method, **select_kw)
    if not chosen:
        raise ValueError("the selection keeps no feature; loosen its threshold")
    split = splits.time_split(frame)
    fitted, hist = ensemble.train_many(split, chosen, "target_return_1d", list(models))
    best = ensemble.best_model(hist).first()
    name = best["model"] if best else next(iter(fitted))
    if save_root:
        fitted[name].save(frame.sparkSession, f"{save_root}/{name}/{int(time.time() * 1000)}")
    return name, fitted, hist, chosen
