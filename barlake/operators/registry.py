"""Feature registry — named ``DataFrame -> DataFrame`` stages used with
``DataFrame.transform``; users add their own with :func:`register_feature`."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame

from barlake.operators import basic, engineered, technical

FEATURES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "returns": basic.returns,
    "basic_indicators": basic.technical_basic,
    "calendar": basic.calendar_features,
    "price": engineered.price_features,
    "volume": engineered.volume_features,
    "sma": engineered.sma_features,
    "bollinger": engineered.bollinger_pop,
    "kdj": engineered.kdj,
    "lags": engineered.lag_features,
    "time": engineered.time_features,
    "window_indicators": technical.window_indicators,
}


def register_feature(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    FEATURES[name] = fn


def apply_features(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Chain the named stages; returns the frame and the columns they added."""
    base = set(df.columns)
    out = df
    for n in names:
        out = out.transform(FEATURES[n])
    return out, [c for c in out.columns if c not in base]
