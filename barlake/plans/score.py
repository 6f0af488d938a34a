"""Prediction plan (reference entry point 3): look-back scan sized by the
longest feature window → features → newest bar per instrument → score →
top/bottom lists → timestamped outputs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators import models as M
from barlake.operators import ranking
from barlake.plans.train import build_training_frame
from barlake.sources import runs


def score_latest(bars: DataFrame, model: M.FittedModel, n: int = 10, at=None) -> tuple[DataFrame, DataFrame]:
    """Returns (all latest predictions with prices, ranked submission)."""
    frame, _ = build_training_frame(bars)
    latest = ranking.latest_rows(frame.select(*dict.fromkeys(["stock_code", "date", "close", *model.features])))  # the close may be a feature
    pred = M.predict(model, latest, keep=["stock_code", "date", "close"])
    pred = ranking.predict_price(pred, "predicted_return", "close", at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    return pred, ranking.submission(pred, n)


def save_predictions(pred: DataFrame, ranked: DataFrame, root: str, run_id: str | None = None,
                     score: str = "predicted_return") -> str:
    """K3-K6: submission CSV (one file), detailed predictions, nested record, as one committed run
    of ``root`` (see :mod:`barlake.sources.runs`); returns its id, by default the time of the run."""
    with runs.RunWriter(pred.sparkSession, root, run_id) as run:
        run.write("submission", ranked.coalesce(1), "csv").write("detailed", pred)
        run.write("record", ranking.submission_record(ranked, score).coalesce(1), "json")
    return run.run_id


def lookback_start(end, longest_window: int = 60, bar: str = "day") -> F.Column:
    """Scan start so the longest feature window is full at the newest bar."""
    end = F.to_date(F.lit(end)) if isinstance(end, str) else end
    return F.date_sub(end, int(longest_window * (1.6 if bar == "day" else 1)))
