"""Data preparation plan (reference entry point 1): read → validate → clean →
fill → returns → indicators → calendar → write, as one lazy plan with one
shuffle by instrument (all windows share it)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barlake.operators import basic, clean
from barlake.sources import files as IO


def prepare(bars: DataFrame, fill: str = "forward_fill", periods=(1, 5, 10, 20)) -> DataFrame:
    cleaned = clean.clean_bars(bars)
    filled = clean.handle_missing(cleaned, fill, columns=[c for c in ("open", "high", "low", "close", "volume")
                                                           if c in cleaned.columns])
    return basic.preprocess(filled, periods=periods)


def prepare_and_write(bars: DataFrame, path: str) -> DataFrame:
    """K1 + K2: write the processed panel partitioned by year, return its summary."""
    out = prepare(bars)
    IO.save_bars(out, path)
    back = out.sparkSession.read.parquet(path)
    feats = [c for c in back.columns if c not in bars.columns and c != "year"]
    return IO.dataset_summary(back, feats)
