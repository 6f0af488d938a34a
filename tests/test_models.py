"""Model recovery on planted data (fixture C shape: 1000 x 20, noise 0.1, seed 42)."""
import numpy as np
import pandas as pd
import pytest

from barlake.operators import models as M

FEATS = [f"feature_{i}" for i in range(20)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(0, 1, (1000, 20))
    w = rng.normal(0, 1, 20)
    y = x @ w + 0.5 + rng.normal(0, 0.1, 1000)
    pdf = pd.DataFrame(x, columns=FEATS).assign(target=y, stock_code="s", date=pd.date_range("2020-01-01", periods=1000).date)
    return pdf, w, spark.createDataFrame(pdf)


def test_linear_recovers_coefficients(planted):
    pdf, w, df = planted
    m = M.fit("linear", df, FEATS, "target")
    pred = M.predict(m, df, keep=["target"]).toPandas()
    assert np.sqrt(((pred.target - pred.predicted_return) ** 2).mean()) < 0.12
    imp = M.importances(m).toPandas()
    assert len(imp) == 20


def test_ridge_matches_closed_form(planted):
    pdf, w, df = planted
    m = M.fit("ridge", df, FEATS, "target", alpha=10.0)
    x = pdf[FEATS].to_numpy()
    xs = (x - x.mean(0)) / x.std(0)
    yc = pdf.target.to_numpy() - pdf.target.mean()
    coef = np.linalg.solve(xs.T @ xs + 10.0 * np.eye(20), xs.T @ yc)
    ref = xs @ coef + pdf.target.mean()
    pred = M.predict(m, df, keep=["target"]).toPandas()
    np.testing.assert_allclose(pred.predicted_return, ref, atol=1e-6)


def test_bayesian_ridge_close_to_ols(planted):
    pdf, w, df = planted
    m = M.fit("bayesian_ridge", df, FEATS, "target")
    spread = np.array([m.scaler[c][1] for c in FEATS])  # coefficients are of standardised features
    np.testing.assert_allclose(np.array(m.extra["coef"]) / spread, w, atol=0.02)
    out = m.transform(df).select("prediction", "uncertainty").toPandas()
    assert (out.uncertainty > 0).all()


def test_save_load_roundtrip(spark, planted, tmp_path):
    pdf, w, df = planted
    m = M.fit("ridge", df, FEATS, "target")
    m.save(spark, str(tmp_path / "ridge" / "run1"))
    back = M.FittedModel.load(spark, M.latest_run(spark, str(tmp_path), "ridge"))
    a = M.predict(m, df, keep=["date"]).toPandas().sort_values("date")
    b = M.predict(back, df, keep=["date"]).toPandas().sort_values("date")
    np.testing.assert_allclose(a.predicted_return, b.predicted_return, rtol=1e-9)


def test_forest_importances_find_planted_signal(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 5))
    y = 3 * x[:, 2] + rng.normal(0, 0.1, 600)
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"f{i}" for i in range(5)]).assign(t=y))
    m = M.fit("bagging", df, [f"f{i}" for i in range(5)], "t")
    top = M.importances(m).first()
    assert top.feature == "f2"


def test_gram_statistics_of_many_features(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(50, 1, (300, 62))
    cols = [f"c{i}" for i in range(62)]
    y = x[:, 0] * 2 + 1
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(label=y)).repartition(3)
    n, mx, my, xx, xy, yy = M.gram_stats(df, cols)
    c = x - x.mean(0)
    assert n == 300 and my == pytest.approx(y.mean())
    np.testing.assert_allclose(mx, x.mean(0))
    np.testing.assert_allclose(xx, c.T @ c, atol=1e-8)
    np.testing.assert_allclose(xy, c.T @ (y - y.mean()), atol=1e-8)
    assert yy == pytest.approx(((y - y.mean()) ** 2).sum())


def _scaled_sample(spark, scales):
    rng = np.random.default_rng(2)
    z = rng.normal(0, 1, (200, 3))
    y = z @ [1.0, -2.0, 0.5] + rng.normal(0, 0.3, 200)
    x = z * scales + np.array([5.0, -1.0, 3.0]) * scales
    cols = ["a", "b", "c"]
    return cols, x, y, spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(t=y))


def test_bayesian_ridge_does_not_depend_on_units(spark):
    preds = []
    for scales in ([1.0, 1.0, 1.0], [1e-3, 1e4, 30.0]):
        cols, _, _, df = _scaled_sample(spark, np.array(scales))
        m = M.fit("bayesian_ridge", df, cols, "t")
        preds.append(M.predict(m, df, keep=["t"]).orderBy("t").toPandas()["predicted_return"].to_numpy())
    np.testing.assert_allclose(preds[0], preds[1], rtol=1e-6)


def test_polynomial_is_ridge_on_standardised_raw_terms(spark):
    cols, x, y, df = _scaled_sample(spark, np.array([1e-1, 20.0, 3.0]))
    m = M.fit("polynomial", df, cols, "t")
    got = M.predict(m, df, keep=["t"]).orderBy("t").toPandas()["predicted_return"].to_numpy()
    p = np.column_stack([*x.T, *[x[:, i] * x[:, j] for i in range(3) for j in range(i, 3)]])
    z = (p - p.mean(0)) / p.std(0)
    b = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y - y.mean()))
    np.testing.assert_allclose(got, (z @ b + y.mean())[np.argsort(y)], atol=1e-6)


def test_adaboost_survives_saving(spark, tmp_path):
    cols, _, _, df = _scaled_sample(spark, np.ones(3))
    m = M.fit("adaboost", df, cols, "t", n_estimators=3)
    m.save(spark, str(tmp_path / "ada"))
    back = M.FittedModel.load(spark, str(tmp_path / "ada"))
    a, b = (M.predict(x, df, keep=["t"]).orderBy("t").toPandas()["predicted_return"] for x in (m, back))
    np.testing.assert_allclose(a, b)


def test_selection_keeps_rows_with_a_missing_feature(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (2.0, 4.0, None), (None, 6.0, 3.0)], "a double, b double, t double")
    got = sorted(tuple(r) for r in M._selection_frame(df, ["a", "b"], "t").collect())
    assert got == [(1.0, 6.0, 1.0), (1.0, 6.0, 3.0)]


def test_total_loss_is_a_drawdown_of_one(spark):
    from barlake.operators.portfolio import max_drawdown
    df = spark.createDataFrame([("x", i, r) for i, r in enumerate([0.1, -1.0, 0.1])], "stock_code string, date int, r double")
    assert max_drawdown(df, "r").first().max_drawdown == -1.0


def test_a_tick_past_the_last_bar_takes_it(spark):
    from barlake.operators.relational import asof_previous_bar
    bars = spark.sql("select 'k' as stock_code, timestamp_ntz'2024-01-01 00:00:00' as date, 1.0D as close "
                     "union all select 'k', timestamp_ntz'2024-01-01 01:00:00', 2.0D")
    ticks = spark.sql("select 'k' as event_type, timestamp_ntz'2024-01-01 05:30:00' as ts union all "
                      "select 'k', timestamp_ntz'2024-01-01 00:30:00' union all select 'z', timestamp_ntz'2024-01-01 05:30:00'")
    got = {(r.event_type, r.ts.hour): r.prev_close for r in asof_previous_bar(ticks, bars).collect()}
    assert got == {("k", 5): 2.0, ("k", 0): None, ("z", 5): None}


def test_search_ranges_give_parameters_spark_takes(spark):
    import random
    from barlake.operators.tuning import SPACES, sample
    cols, _, _, df = _scaled_sample(spark, np.ones(3))
    for name in SPACES:
        params = sample(SPACES[name], random.Random(1)) | ({"maxIter": 2} if "stepSize" in SPACES[name] else {"numTrees": 2} if name == "random_forest" else {})
        assert M.fit(name, df, cols, "t", **params).features == cols


def test_rfe_query_grows_100_trees(spark, monkeypatch):
    from barlake.operators import models
    from barlake.plans import q_models
    trees, fit = [], models.fit
    monkeypatch.setattr(models, "fit", lambda *a, **k: trees.append(k["numTrees"]) or fit(*a, **{**k, "numTrees": 2}))
    q_models.q_rfe(spark, "/root/testdata/sf0.001")
    assert trees and set(trees) == {100}


def test_rounds_kept_by_patience():
    assert M.stopping_round([3.0, 2.0, 2.5, 2.6, 1.0], patience=2) == 2
    assert M.stopping_round([3.0, 2.0, 2.5, 2.6, 1.0], patience=3) == 5
    assert M.stopping_round([1.0, 1.0, 1.0], patience=50) == 1


def test_booster_stops_early_on_noise_and_goes_on_with_a_signal(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (800, 3))
    cols = ["a", "b", "c"]
    noise, signal = rng.normal(0, 1, 800), np.sin(3 * x[:, 0]) + 0.05 * rng.normal(0, 1, 800)
    rounds = []
    for y in (noise, signal):
        df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(t=y, i=np.arange(800)))
        train, val = df.where("i < 600"), df.where("i >= 600")
        m = M.fit("xgboost", train, cols, "t", validation=val, maxIter=30, maxDepth=3)
        errors = m.extra["validation_errors"]
        rounds.append(m.extra["rounds"])
        assert len(errors) == 30 and m.extra["rounds"] == int(np.argmin(errors)) + 1
        assert m.pipeline.stages[-1].getNumTrees == m.extra["rounds"]
        got = M.metrics(M.predict(m, val, keep=["t"]), "t")["mse"]
        assert got == pytest.approx(min(errors))
    assert rounds[0] < 10 < rounds[1]
    m.save(spark, str(tmp_path / "x"))
    assert M.FittedModel.load(spark, str(tmp_path / "x")).extra["rounds"] == rounds[1]


def test_training_records_rounds_and_failures(spark):
    from barlake.operators.ensemble import train_many
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(0, 1, (200, 2)), columns=["a", "b"]).assign(t=rng.normal(0, 1, 200), split=["train"] * 150 + ["val"] * 50)
    fitted, hist = train_many(spark.createDataFrame(pdf), ["a", "b"], "t", ["ridge", "no such model"])
    rows = {r.model: r for r in hist.collect()}
    assert rows["ridge"].status == "ok" and "KeyError" in rows["no such model"].status and list(fitted) == ["ridge"]


def test_stacking_equals_out_of_fold_ridge(spark):
    """Closed-form bases: the meta model sees the predictions of fits on the other folds."""
    from barlake.operators import ensemble as E
    rng = np.random.default_rng(6)
    n, k = 120, 5
    x = rng.normal(0, 1, (n, 2))
    y = x @ [1.0, -0.5] + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(t=y, stock_code="s", date=pd.date_range("2020-01-01", periods=n).date)

    def ridge(x, y, alpha, at):
        m, s = x.mean(0), x.std(0)
        z = (x - m) / s
        w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
        return (at - m) / s @ w + y.mean()
    fold = np.repeat(np.arange(k), n // k)
    oof = np.column_stack([np.concatenate([ridge(x[fold != f], y[fold != f], a, x[fold == f]) for f in range(k)]) for a in (0.0, 1.0)])
    full = np.column_stack([ridge(x, y, a, x) for a in (0.0, 1.0)])
    want = ridge(oof, y, 1.0, full)
    ens = E.stacking(spark.createDataFrame(pdf), ["a", "b"], "t", bases=("linear", "ridge"), k=k)
    got = ens.predict(spark.createDataFrame(pdf)).toPandas().sort_values("date").predicted_return
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_a_family_that_fails_stays_in_the_history(spark):
    from barlake.operators.tuning import best_of_families, search_many
    cols, _, _, df = _scaled_sample(spark, np.ones(3))
    hist = search_many(["ridge", "unknown"], df.withColumn("stock_code", df.a.cast("string")).selectExpr("*", "date'2020-01-01' as date"), cols, "t", n_trials=2, k=2)
    rows = {r.model: r for r in best_of_families(hist).collect()}
    assert rows["ridge"].rank == 1 and rows["ridge"].score > 0 and rows["unknown"].rank == 2 and "KeyError" in rows["unknown"].error


def test_asof_join_over_irregular_bars(spark):
    import datetime as dt
    import random as rnd

    from barlake.operators.relational import asof_join, asof_previous_bar
    rng = rnd.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    bars = sorted({(k, t0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 20))) for k in "ab" for _ in range(40)})
    ticks = [(rng.choice(["a", "b", "c", None]), t0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 25)) if rng.random() < 0.95 else None, i) for i in range(400)]
    left = spark.createDataFrame(ticks, "k string, ts timestamp_ntz, i int")
    right = spark.createDataFrame([(k, t, float(j)) for j, (k, t) in enumerate(bars)], "k string, at timestamp_ntz, v double")
    got = {r.i: r.found for r in asof_join(left, right, "k", "ts", "k", "at", {"v": "found"}).collect()}
    want = {}
    for k, t, i in ticks:
        before = [j for j, (b, at) in enumerate(bars) if t is not None and b == k and at <= t]
        want[i] = float(before[-1]) if before else None
    assert got == want
    months = spark.sql("select 'k' as stock_code, timestamp_ntz'2024-01-01 00:00:00' as date, 1.0D as close union all select 'k', timestamp_ntz'2024-03-01 00:00:00', 3.0D")
    probe = spark.sql("select 'k' as event_type, timestamp_ntz'2024-02-10 00:00:00' as ts union all select 'k', timestamp_ntz'2024-03-31 23:00:00' union all select 'k', timestamp_ntz'2024-04-01 00:00:00'")
    assert {r.ts.month: r.prev_close for r in asof_previous_bar(probe, months, step="1 month").collect()} == {2: 1.0, 3: 1.0, 4: 3.0}


def test_sequences_of_short_series_and_scaling(spark):
    from barlake.operators.relational import latest_sequences, sequence_scale, sequence_windows
    rows = [("long", i, float(i), 5.0) for i in range(10)] + [("short", i, 20.0 + i, 5.0) for i in range(3)]
    df = spark.createDataFrame(rows, "stock_code string, date int, x double, flat double")
    scale = sequence_scale(df, ["x", "flat"], "x")
    got = {r.stock_code: (r.n_rows, [v[0] for v in r.sequence], r.date) for r in latest_sequences(df, ["x", "flat"], 5, scale=scale).collect()}
    assert got == {"long": (5, pytest.approx([v / 22 for v in (5, 6, 7, 8, 9)]), 9), "short": (3, [1.0] * 5, 2)}
    one = sequence_windows(df, ["x"], "x", 9, scale=scale).collect()
    assert len(one) == 1 and one[0].target == pytest.approx(9 / 22) and [v[0] for v in one[0].sequence] == pytest.approx([v / 22 for v in range(9)])


def test_newest_rows_with_repeats_and_null_instruments(spark):
    from barlake.operators.ranking import latest_rows
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 2, 2.0), (None, 5, 3.0), ("b", None, 4.0)], "stock_code string, date int, v double")
    assert sorted(map(tuple, latest_rows(df).collect()), key=str) == sorted([("a", 2, 2.0), (None, 5, 3.0), ("b", None, 4.0)], key=str)


def test_a_ridge_search_reads_the_rows_as_often_for_many_trials(spark):
    from barlake.operators import splits as S
    from barlake.operators.tuning import cv_score, random_search
    rng = np.random.default_rng(8)
    x = rng.normal([5.0, -300.0, 0.0], [1.0, 40.0, 1e-3], (240, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(flat=0.1, t=x @ [1.0, 0.02, 300.0] + rng.normal(0, 0.5, 240), stock_code="s",
                                                          date=pd.date_range("2020-01-01", periods=240).date)
    df, cols, tracker = spark.createDataFrame(pdf).repartition(3).cache(), ["a", "b", "c", "flat"], spark.sparkContext.statusTracker()
    for ordered in (False, True):
        jobs, found = [], {}
        for n in (1, 6):
            before = len(tracker.getJobIdsForGroup(None))
            found[n] = random_search("ridge", df, cols, "t", n_trials=n, k=3, time_series=ordered).orderBy("trial").collect()
            jobs.append(len(tracker.getJobIdsForGroup(None)) - before)
        assert abs(jobs[1] - jobs[0]) <= 3
        blocks = S.expanding_blocks(df, 3, out="_block") if ordered else S.shuffled_folds(df, 3, out="_block")
        for r in found[6][:2]:
            want = cv_score("ridge", blocks, cols, "t", {"alpha": float(r.params["alpha"])}, 3, ordered)
            assert r.error is None and r.score == pytest.approx(want, rel=1e-6)  # the pipeline fits rounding noise of the constant column
