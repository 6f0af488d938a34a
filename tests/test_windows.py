"""Window features against pandas rolling, plus panel properties."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barlake.functions.windows import DEFAULT as S
from barlake.operators import basic, engineered, technical


def _by_stock(pdf, fn):
    return pd.concat([fn(g.sort_values("date")) for _, g in pdf.groupby("stock_code")])


def test_rolling_matches_pandas(walk_df, walk_panel):
    out = engineered.lag_features(engineered.price_features(walk_df)).toPandas()

    def ref(g):
        r = pd.DataFrame({"stock_code": g.stock_code, "date": g.date})
        r["r_mean_10"] = g.close.rolling(10).mean()
        r["r_std_20"] = g.close.rolling(20).std()
        r["r_ret_5"] = g.close.pct_change(5)
        r["r_pp_20"] = g.close.rolling(20).rank(pct=True)
        r["r_lag_3"] = g.close.shift(3)
        return r

    m = out.merge(_by_stock(walk_panel, ref), on=["stock_code", "date"])
    for a, b in (("close_mean_10", "r_mean_10"), ("close_std_20", "r_std_20"), ("return_5d", "r_ret_5"),
                 ("price_position_20d", "r_pp_20"), ("close_lag_3", "r_lag_3")):
        np.testing.assert_allclose(m[a].astype(float), m[b].astype(float), rtol=1e-9, equal_nan=True)


def test_simple_rsi_and_bollinger_match_pandas(walk_df, walk_panel):
    out = basic.technical_basic(walk_df).toPandas()

    def ref(g):
        d = g.close.diff()
        gain = d.where(d > 0, 0).rolling(14).mean()
        loss = (-d.where(d < 0, 0)).rolling(14).mean()
        r = pd.DataFrame({"stock_code": g.stock_code, "date": g.date})
        r["r_rsi"] = 100 - 100 / (1 + gain / loss)
        r["r_bbu"] = g.close.rolling(20).mean() + 2 * g.close.rolling(20).std()
        return r

    m = out.merge(_by_stock(walk_panel, ref), on=["stock_code", "date"])
    np.testing.assert_allclose(m.rsi.astype(float), m.r_rsi.astype(float), rtol=1e-9, equal_nan=True)
    np.testing.assert_allclose(m.bb_upper.astype(float), m.r_bbu.astype(float), rtol=1e-9, equal_nan=True)


def test_volume_price_corr_matches_pandas(walk_df, walk_panel):
    out = engineered.volume_features(walk_df).toPandas()

    def ref(g):
        return pd.DataFrame({"stock_code": g.stock_code, "date": g.date,
                             "r": g.volume.rolling(20).corr(g.close)})

    m = out.merge(_by_stock(walk_panel, ref), on=["stock_code", "date"])
    np.testing.assert_allclose(m.volume_price_corr.astype(float), m.r.astype(float), atol=1e-9, equal_nan=True)


def test_no_nan_or_inf_anywhere(walk_df):
    out = technical.window_indicators(walk_df)
    dbl = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    bad = out.select(*[F.sum((F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).cast("int")).alias(c)
                       for c in dbl]).first().asDict()
    assert all((v or 0) == 0 for v in bad.values()), bad


def test_warmup_nulls(walk_df):
    out = basic.technical_basic(walk_df).where("stock_code = 'S00'").orderBy("date").select("ma_50").toPandas()
    assert out.ma_50[:49].isna().all() and out.ma_50[49:].notna().all()


def test_permutation_and_partition_invariance(spark, walk_df):
    a = technical.window_indicators(walk_df).orderBy("stock_code", "date").select("stock_code", "date", "cci", "willr_14", "obv")
    shuffled = walk_df.repartition(7).orderBy(F.rand(3))
    b = technical.window_indicators(shuffled).orderBy("stock_code", "date").select("stock_code", "date", "cci", "willr_14", "obv")
    pa, pb = a.toPandas(), b.toPandas()
    pd.testing.assert_frame_equal(pa, pb)


def test_no_cross_instrument_leak(walk_df):
    one = walk_df.where("stock_code = 'S03'")
    alone = engineered.kdj(one).orderBy("date").select("k", "d", "j").toPandas()
    together = engineered.kdj(walk_df).where("stock_code = 'S03'").orderBy("date").select("k", "d", "j").toPandas()
    pd.testing.assert_frame_equal(alone, together)


def test_single_exchange_for_all_windows(walk_df):
    out = technical.window_indicators(walk_df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
