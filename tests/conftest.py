import os
import sys

import numpy as np
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from barlake.session import get_session
    s = get_session("local[4]", 8, app_name="barlake-tests")
    yield s


@pytest.fixture(scope="session")
def walk_panel():
    """Fixture B shape: 10 instruments x 1000 daily bars, log-normal random walk."""
    rng = np.random.default_rng(7)
    frames = []
    for i in range(10):
        n = 1000
        close = 100 * np.exp(np.cumsum(rng.normal(0.001, 0.02, n)))
        high = close * (1 + np.abs(rng.normal(0, 0.005, n)))
        low = close * (1 - np.abs(rng.normal(0, 0.005, n)))
        open_ = np.clip(close * (1 + rng.normal(0, 0.003, n)), low, high)
        vol = np.round(rng.lognormal(15, 1, n))
        dates = pd.date_range("2020-01-01", periods=n, freq="D")
        frames.append(pd.DataFrame({"stock_code": f"S{i:02d}", "date": dates.date, "open": open_,
                                    "high": high, "low": low, "close": close, "volume": vol,
                                    "amount": close * vol}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def walk_df(spark, walk_panel):
    return spark.createDataFrame(walk_panel)
