"""Blocked (halo) execution equals the plain per-instrument windows."""
import numpy as np
import pandas as pd

from barlake.operators import technical as T
from barlake.plans.blocked import blocked_cumulative_sum, blocked_window_indicators, positions


def test_positions_dense(walk_df):
    p = positions(walk_df, bucket_seconds=7 * 86400).toPandas()
    for _, g in p.groupby("stock_code"):
        g = g.sort_values("date")
        assert g._pos.tolist() == list(range(len(g)))


def test_blocked_indicators_equal_plain(walk_df):
    cols = ["sma_60", "wma_20", "willr_21", "cci", "bb_width_26", "tr", "aroon_up", "mfi",
            "volume_ratio_20", "doji", "hammer", "obv", "vwap"]
    plain = T.window_indicators(walk_df).select("stock_code", "date", *cols).toPandas()
    blk = blocked_window_indicators(walk_df, block_rows=97, lookback=64).select("stock_code", "date", *cols).toPandas()
    m = plain.merge(blk, on=["stock_code", "date"], suffixes=("", "_b"))
    assert len(m) == len(plain) == len(blk)
    for c in cols:
        np.testing.assert_allclose(m[c].astype(float), m[c + "_b"].astype(float), rtol=1e-9, equal_nan=True)


def test_blocked_cumsum(walk_df, walk_panel):
    out = blocked_cumulative_sum(walk_df, "volume", "cv", block_rows=50).toPandas()
    ref = walk_panel.sort_values(["stock_code", "date"]).assign(ref=lambda d: d.groupby("stock_code").volume.cumsum())
    m = out.merge(ref[["stock_code", "date", "ref"]], on=["stock_code", "date"])
    np.testing.assert_allclose(m.cv, m.ref, rtol=1e-12)


def test_every_recursion_in_blocks_equals_one_bar_after_another(spark, walk_df, walk_panel):
    import sequential as Q

    from barlake.operators import recursive as R
    kinds = ("ema_engineered", "ewm_macd", "rsi14", "ema_technical", "tema", "rsi_multi", "atr", "adx", "sar", "ht")
    for chosen, rows in ((kinds, 130), (("macd_seeded", "sar"), 400)):
        cols = R.output_columns(chosen)
        out = R.apply_recursive(walk_df, chosen, block_rows=rows, bucket_seconds=9 * 86400).select("stock_code", "date", *cols).toPandas()
        ref = pd.concat([Q.compute(g, chosen, "date") for _, g in walk_panel.groupby("stock_code")])
        m = out.merge(ref, on=["stock_code", "date"], suffixes=("", "_r"))
        assert len(m) == len(walk_panel) == len(out)
        for c in cols:
            np.testing.assert_allclose(m[c].astype(float), m[c + "_r"].astype(float), rtol=1e-8, atol=1e-8, equal_nan=True, err_msg=c)


def test_blocks_of_a_hot_instrument(spark):
    """One instrument with most rows: its bars are many blocks, each at most block_rows and a bucket long;
    null closes, a null instrument, an instrument of one bar."""
    import sequential as Q

    from barlake.functions.windows import DEFAULT
    from barlake.operators import recursive as R
    from barlake.operators.scans import BLOCK, blocked_panel
    rng = np.random.default_rng(9)
    frames = []
    for name, n in (("hot", 3000), (None, 400), ("one", 1), ("late", 500)):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        if name == "late":
            c[:300] = np.nan
        frames.append(pd.DataFrame({"stock_code": name, "date": pd.date_range("2020-01-01", periods=n).date, "high": c * 1.01,
                                    "low": c * 0.99, "close": c, "close2": 1}))
    panel = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(panel, "stock_code string, date date, high double, low double, close double, close2 int")
    df = df.selectExpr("stock_code", "date", *[f"nullif({c}, 'NaN') as {c}" for c in ("high", "low", "close")], "close2")
    blocks = blocked_panel(df, DEFAULT, 200, 10 * 86400)[0].groupBy("stock_code", BLOCK).count().collect()
    assert max(r["count"] for r in blocks if r.stock_code != "late") <= 210 and sum(r.stock_code == "hot" for r in blocks) >= 14
    kinds = ("ewm_macd", "rsi14", "tema", "atr", "adx")
    out = R.apply_recursive(df, kinds, block_rows=200, bucket_seconds=10 * 86400).toPandas()
    ref = pd.concat([Q.compute(g, kinds, "date") for _, g in panel.groupby("stock_code", dropna=False)])
    m = out.merge(ref, on=["stock_code", "date"], suffixes=("", "_r"))
    assert len(m) == len(panel) == len(out)
    for c in R.output_columns(kinds):
        keep = m.stock_code != "late" if c in ("rsi", "atr_14", "atr_21", "adx") else m.stock_code == m.stock_code
        np.testing.assert_allclose(m[keep][c].astype(float), m[keep][c + "_r"].astype(float), rtol=1e-8, atol=1e-8, equal_nan=True, err_msg=c)
