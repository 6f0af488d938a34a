"""Distributed ranks / top-n against brute force; evaluation metrics against numpy."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.functions.ranks import average_rank, date_offsets, top_n_per_group, value_counts
from barlake.operators import evaluate as V


@pytest.fixture(scope="module")
def tied(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 2000), "v": rng.integers(0, 50, 2000).astype(float),
                        "id": np.arange(2000)})
    return pdf, spark.createDataFrame(pdf)


def test_average_rank_matches_pandas(tied):
    pdf, df = tied
    out = average_rank(df, "v", ["g"], "r", ranges=7).toPandas().sort_values("id")
    ref = pdf.assign(r=pdf.groupby("g").v.rank(method="average")).sort_values("id")
    np.testing.assert_allclose(out.r.to_numpy(), ref.r.to_numpy())


def test_value_counts_are_lazy_and_spread_ties(spark):
    """90 % of the rows hold one value: it is one row after the map side, and no job runs before the action."""
    rng = np.random.default_rng(4)
    v = np.where(rng.random(20_000) < 0.9, 0.0, rng.normal(size=20_000))
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 20_000), "v": v})
    pdf.loc[:9, "v"] = np.nan
    df = spark.createDataFrame(pdf).selectExpr("g", "nullif(v, 'NaN') as v").repartition(6)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "value_counts")
    counts = value_counts(df, "v", ["g"])
    ranks = average_rank(df, "v", ["g"], "r")
    assert not jobs.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = counts.toPandas().sort_values(["g", "value"])
    ref = pdf.dropna().groupby(["g", "v"]).size().reset_index(name="n")
    ref["below"] = ref.groupby("g").n.cumsum() - ref.n
    np.testing.assert_allclose(got[["value", "n", "below"]].to_numpy(float), ref[["v", "n", "below"]].to_numpy(float))
    r = ranks.toPandas()
    assert r.r.isna().sum() == 10
    np.testing.assert_allclose(np.sort(r.r.dropna()), np.sort(pdf.dropna().groupby("g").v.rank(method="average")))


def test_qq_points_of_tied_residuals(spark):
    pdf = pd.DataFrame({"model": ["m"] * 30_000, "y": [0.0] * 27_000 + list(np.arange(3000) - 1500.0), "p": 0.0})
    out = V.residual_qq(spark.createDataFrame(pdf)).toPandas().sort_values("i")
    assert out.i.tolist() == list(range(1, 30_001))
    np.testing.assert_array_equal(out.residual, np.sort(pdf.y))


def test_top_n_per_group_exact(tied):
    pdf, df = tied
    out = top_n_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 5, buckets=4).toPandas()
    ref = pdf.sort_values(["g", "v", "id"], ascending=[True, False, True]).groupby("g").head(5)
    assert sorted(out.id) == sorted(ref.id)


def test_date_offsets(spark):
    pdf = pd.DataFrame({"date": [3, 1, 2, 1, 3, 3], "k": ["b", "a", "a", "b", "a", "c"]})
    out = date_offsets(spark.createDataFrame(pdf), "date", "k").toPandas().sort_values("pos")
    assert list(zip(out.date, out.k)) == [(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b"), (3, "c")]


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(12)
    n = 500
    y = rng.normal(0, 1, n)
    p = 0.5 * y + rng.normal(0, 1, n)
    pdf = pd.DataFrame({"model": "m", "stock_code": [f"s{i % 7}" for i in range(n)],
                        "date": pd.date_range("2021-01-01", periods=n, freq="h"), "y": y, "p": p})
    return pdf, spark.createDataFrame(pdf)


def test_regression_metrics_numpy(preds):
    pdf, df = preds
    r = V.regression_metrics(df).first()
    e = pdf.y - pdf.p
    assert r.mse == pytest.approx((e ** 2).mean())
    assert r.r2 == pytest.approx(1 - (e ** 2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum())
    assert r.pearson_corr == pytest.approx(np.corrcoef(pdf.y, pdf.p)[0, 1])
    assert r.median_ae == pytest.approx(np.median(np.abs(e)))
    assert r.direction_accuracy == pytest.approx(np.mean(np.sign(pdf.y) == np.sign(pdf.p)))


def test_spearman_numpy(preds):
    pdf, df = preds
    r = V.spearman(df).first().spearman_corr
    ry, rp = pdf.y.rank(), pdf.p.rank()
    assert r == pytest.approx(np.corrcoef(ry, rp)[0, 1])


def test_information_ratio_numpy(preds):
    pdf, df = preds
    r = V.information_ratio(df).first()
    s = pdf.sort_values(["date", "stock_code"]).reset_index(drop=True)
    ics = [np.corrcoef(s.y[i:i + 20], s.p[i:i + 20])[0, 1] for i in range(0, len(s) - 20, 5)]
    ic = np.corrcoef(s.y, s.p)[0, 1]
    assert r.information_ratio == pytest.approx(ic / np.std(ics))


def test_portfolio_numpy(preds):
    pdf, df = preds
    r = V.portfolio_metrics(df).first()
    top = pdf.sort_values("p").tail(10)
    assert r.top_n == 10
    assert r.portfolio_return == pytest.approx(top.y.mean())
    assert r.sharpe_ratio == pytest.approx(top.y.mean() / top.y.std(ddof=0))


def test_jarque_bera_numpy(preds):
    pdf, df = preds
    r = V.jarque_bera(df).first()
    e = (pdf.y - pdf.p).to_numpy()
    m = e - e.mean()
    s = (m ** 3).mean() / (m ** 2).mean() ** 1.5
    k = (m ** 4).mean() / (m ** 2).mean() ** 2 - 3
    assert r.jarque_bera == pytest.approx(len(e) / 6 * (s ** 2 + k ** 2 / 4))


def test_distributed_quantiles_match_numpy(tied):
    from barlake.functions.quantiles import quantiles
    pdf, df = tied
    out = quantiles(df, ["v", "id"], [0.0, 0.1, 0.5, 0.75, 1.0], ["g"]).toPandas()
    for (g, col, q), val in out.set_index(["g", "column", "q"])["value"].items():
        ref = np.quantile(pdf[pdf.g == g][col].astype(float), q)
        assert val == pytest.approx(ref)


def test_bracketed_quantiles_of_tied_values_are_exact_and_lazy(spark):
    from barlake.functions import quantiles as Q
    rng = np.random.default_rng(3)
    v = np.where(rng.random(240_000) < 0.9, 0.0, rng.normal(0, 1, 240_000))
    g = np.where(np.arange(240_000) % 3 == 0, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v})).repartition(4)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantile-plan", "")
    qs = [0.0, 0.02, 0.25, 0.5, 0.97, 1.0]
    plan = Q.quantiles(df, ["v"], qs, ["g"])
    assert not jobs.getJobIdsForGroup("quantile-plan")
    got = {(r.g, r.q): r.value for r in plan.collect()}
    for name in "ab":
        for q in qs:
            assert got[name, q] == pytest.approx(np.quantile(v[g == name], q), abs=1e-12)


@pytest.mark.parametrize("width", [10, 45])
def test_correlations_are_pairwise_complete_at_any_width(spark, width):
    from barlake.operators.selection import correlation_pairs
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, width))
    x[:, 3] = x[:, 0] * 2 + rng.normal(0, 0.01, 400)
    x[:, 4] = 7.1
    x[rng.random((400, width)) < 0.3] = np.nan
    feats = [f"f{i}" for i in range(width)]
    pdf = pd.DataFrame(x * 1e3 + 1e5, columns=feats)
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in pdf.to_numpy()],
                               ", ".join(f"{f} double" for f in feats)).repartition(3)
    want = pdf.drop(columns="f4").corr().abs()
    got = correlation_pairs(df, feats).toPandas()
    assert len(got) == width * (width - 1) // 2
    for r in got.itertuples():
        if "f4" in (r.left, r.right):
            assert pd.isna(r.corr)
        else:
            assert r.corr == pytest.approx(want.loc[r.left, r.right], abs=1e-9)
