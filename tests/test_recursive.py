"""Recursive kernels against pandas / hand-worked values."""
import numpy as np
import pandas as pd
import pytest

import sequential as Q
from barlake.operators import recursive as R


def test_ema_seeded_hand():
    x = np.array([1.0, 2, 3, 4, 5, 6])
    e = Q.ema_seeded(x, 3)
    assert np.isnan(e[:2]).all()
    assert e[2] == pytest.approx(2.0)                 # mean of 1,2,3
    assert e[3] == pytest.approx(0.5 * 4 + 0.5 * 2.0)  # alpha = 2/(3+1)
    assert e[4] == pytest.approx(0.5 * 5 + 0.5 * e[3])


def test_ewm_adjusted_matches_pandas():
    x = np.random.default_rng(1).normal(100, 5, 300)
    for span in (9, 12, 26):
        ours = Q.ewm_adjusted(x, span)
        ref = pd.Series(x).ewm(span=span).mean().to_numpy()
        np.testing.assert_allclose(ours, ref, rtol=1e-12)


def test_rsi_wilder_equals_wilder_smoothing():
    c = 100 + np.cumsum(np.random.default_rng(2).normal(0, 1, 200))
    n = 14
    ours = Q.rsi_wilder(c, n)
    d = np.diff(c)
    g, lo = np.clip(d, 0, None), np.clip(-d, 0, None)
    ag, al = g[:n].mean(), lo[:n].mean()
    ref = [100 * ag / (ag + al)]
    for t in range(n, len(d)):
        ag = ag + (g[t] - ag) / n
        al = al + (lo[t] - al) / n
        ref.append(100 * ag / (ag + al))
    assert np.isnan(ours[:n]).all()
    np.testing.assert_allclose(ours[n:], ref, rtol=1e-10)


def test_rsi_flat_series_is_zero():
    assert Q.rsi_wilder(np.full(30, 5.0), 14)[14:].tolist() == [0.0] * 16


def test_atr_seed_and_recursion():
    h = np.array([10, 11, 12, 11, 13, 14.0])
    lo = np.array([9, 10, 10, 10, 11, 12.0])
    c = np.array([9.5, 10.5, 11, 10.5, 12.5, 13.5])
    a = Q.atr(h, lo, c, 3)
    tr = Q.true_range(h, lo, c)
    assert a[3] == pytest.approx(np.mean(tr[1:4]))
    assert a[4] == pytest.approx((a[3] * 2 + tr[4]) / 3)


def test_macd_seeded_alignment():
    c = 50 + np.cumsum(np.random.default_rng(3).normal(0, 1, 120))
    line, sig, hist = Q.macd_seeded(c)
    assert np.isnan(line[:33]).all() and not np.isnan(line[33:]).any()
    slow = Q.ema_seeded(c, 26)
    fast = Q.ema_seeded(c, 12, seed_at=25)
    np.testing.assert_allclose(line[33:], (fast - slow)[33:], rtol=1e-12)
    np.testing.assert_allclose(hist[33:], line[33:] - sig[33:], rtol=1e-12)


def test_tema_lookback():
    c = 50 + np.cumsum(np.random.default_rng(4).normal(0, 1, 200))
    t = Q.tema(c, 30)
    assert np.isnan(t[:87]).all() and not np.isnan(t[87:]).any()


def test_adx_range_and_start():
    rng = np.random.default_rng(5)
    c = 100 + np.cumsum(rng.normal(0, 1, 300))
    h, lo = c + rng.uniform(0, 1, 300), c - rng.uniform(0, 1, 300)
    a = Q.adx(h, lo, c, 14)
    assert np.isnan(a[:27]).all() and not np.isnan(a[27:]).any()
    assert ((a[27:] >= 0) & (a[27:] <= 100)).all()


def test_sar_uptrend_then_reversal():
    # steady rise: long, SAR trails below the lows and accelerates
    h = np.array([10, 11, 12, 13, 14, 15, 16, 12, 11, 10.0])
    lo = np.array([9, 10, 11, 12, 13, 14, 15, 9, 8, 7.0])
    s = Q.sar(h, lo)
    assert np.isnan(s[0])
    assert s[1] == pytest.approx(9.0)            # first long SAR = prior low
    assert all(s[t] <= lo[t] for t in range(1, 7))
    assert all(s[t + 1] >= s[t] for t in range(1, 6))
    # the crash at bar 7 reverses to short: SAR jumps to the extreme high
    assert s[7] == pytest.approx(16.0)
    assert all(s[t] >= h[t] for t in range(7, 10))


def test_hilbert_outputs():
    c = 100 + 5 * np.sin(np.arange(400) / 6.0) + np.cumsum(np.random.default_rng(6).normal(0, 0.2, 400))
    tl, mode = Q.hilbert_trend(c)
    assert np.isnan(tl[:63]).all() and not np.isnan(tl[63:]).any()
    assert set(np.unique(mode[63:])) <= {0.0, 1.0}
    assert np.abs(tl[63:] - c[63:]).mean() < 5


def test_apply_recursive_matches_pandas_core(spark, walk_df, walk_panel):
    out = R.apply_recursive(walk_df, R.TECHNICAL).toPandas()
    ref = pd.concat([Q.compute(g, R.TECHNICAL, "date") for _, g in walk_panel.groupby("stock_code")])
    cols = R.output_columns(R.TECHNICAL)
    m = out.merge(ref, on=["stock_code", "date"], suffixes=("", "_r"))
    assert len(m) == len(walk_panel)
    for c in cols:
        np.testing.assert_allclose(m[c].to_numpy(dtype=float), m[c + "_r"].to_numpy(dtype=float),
                                   rtol=1e-12, atol=1e-10, equal_nan=True)
