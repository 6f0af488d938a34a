"""Driver contract: entry smoke, registry shape, oracle agreement on cheap queries."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

CHEAP = ["bars_events", "flagship_top_bottom", "clean_bars", "returns", "kdj", "cci", "aroon",
         "candles", "ema", "rsi_wilder", "adx", "sar", "regression_metrics", "asof_previous_bar", "time_split",
         "stream_ema", "engineered_features", "evaluate_all", "indicator_library", "blocked_ema_rsi"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["stock_code", "date", "close", "return_1d", "sma_5", "k", "d", "j", "rank", "category"]


def test_every_query_has_check_kind():
    from barlake.plans.catalog import load_all
    reg = load_all()
    assert len(reg) >= 100
    assert all(q.check in ("SQL", "REC", "ROWS") for q in reg.values())
    assert set(E.oracle_sql()) <= set(E.queries())


def _canon(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", CHEAP)
def test_oracle_agreement(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "part", "orders", "customer", "nation", "region", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    s = sorted("|".join(_canon(r[c]) for c in sorted(cols)) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in sorted(cols)]
    d = sorted("|".join(_canon(r[i]) for i in idx) for r in res.fetchall())
    assert s == d
