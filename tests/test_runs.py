"""Committed run outputs: readers see whole runs only; text formats keep values."""
import datetime as dt

import pytest

from barlake.plans.score import save_predictions
from barlake.sources import runs


@pytest.fixture
def odd(spark):
    rows = [("a", 1, 0.1 + 0.2, None, dt.date(2024, 1, 2)), ('q"uo,te', None, None, "", None), ("line\nend", -3, 1e300, " x ", dt.date(1970, 1, 1))]
    return spark.createDataFrame(rows, "name string, n bigint, v double, note string, d date")


@pytest.mark.parametrize("fmt", runs.FORMATS)
def test_values_survive_every_format(spark, odd, tmp_path, fmt):
    with runs.RunWriter(spark, str(tmp_path), "r1") as run:
        run.write("t", odd, fmt).write("empty", odd.limit(0), fmt)
    back = runs.read_run(spark, str(tmp_path), "t")
    assert back.schema == odd.schema
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, odd.collect()), key=str)
    assert runs.read_run(spark, str(tmp_path), "empty").count() == 0


def test_a_failed_or_unfinished_run_is_never_read(spark, odd, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        runs.read_run(spark, root, "t")
    with runs.RunWriter(spark, root, "r1") as run:
        run.write("t", odd)
    unfinished = runs.RunWriter(spark, root, "r2").write("t", odd.limit(1))
    with pytest.raises(RuntimeError), runs.RunWriter(spark, root, "r3") as run:
        run.write("t", odd.limit(1))
        raise RuntimeError
    assert runs.committed_runs(spark, root) == ["r1"] and not (tmp_path / "r3").exists()
    assert runs.read_run(spark, root, "t").count() == 3
    with pytest.raises(FileNotFoundError):
        runs.read_run(spark, root, "t", "r2")
    unfinished.commit()
    assert runs.read_run(spark, root, "t").count() == 1
    assert runs.read_run(spark, root, "t", "r1").count() == 3
    with pytest.raises(FileExistsError):
        runs.RunWriter(spark, root, "r2")
    with pytest.raises(KeyError):
        runs.read_run(spark, root, "other")


def test_predictions_are_one_run(spark, tmp_path):
    pred = spark.createDataFrame([("a", 0.1), ("b", -0.2)], "stock_code string, predicted_return double")
    ranked = pred.selectExpr("*", "1 as rank", "if(predicted_return > 0, 'top_gainers', 'top_losers') as category")
    run = save_predictions(pred, ranked, str(tmp_path))
    assert runs.committed_runs(spark, str(tmp_path)) == [run]
    record = runs.read_run(spark, str(tmp_path), "record", run).first()
    assert record.top_gainers_codes == ["a"] and record.top_losers_returns == [-0.2]


def test_the_newest_bars_are_scored_when_the_close_is_a_feature(spark, walk_df):
    from barlake.operators import models as M
    from barlake.plans.score import score_latest
    from barlake.plans.train import build_training_frame
    bars = walk_df.where("date < date'2020-04-10' and stock_code < 'S04'")
    cols = ["return_1d", "close"]
    frame = build_training_frame(bars)[0].where("target_return_1d is not null")
    pred, ranked = score_latest(bars, M.fit("ridge", frame, cols), n=1)
    last = {r.stock_code: r.close for r in bars.where("date = date'2020-04-09'").collect()}
    assert {r.stock_code: r.close for r in pred.collect()} == last
    assert sorted(r.category for r in ranked.collect()) == ["top_gainers", "top_losers"]
