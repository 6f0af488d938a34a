"""Splits in (time, key) order against positions from a sort on the driver."""
import datetime as dt
import random

import pytest

from barlake.operators import splits as S


def rows_of(rng, n_dates, hot=0):
    start = dt.date(2021, 1, 1)
    rows = [(f"s{k:04d}", start + dt.timedelta(d)) for d in range(n_dates) for k in rng.sample(range(300), rng.randrange(1, 9))]
    return rows + [(f"x{k:05d}", start + dt.timedelta(n_dates // 2)) for k in range(hot)]


def labels(df, col):
    return {(r.stock_code, r.date): r[col] for r in df.collect()}


@pytest.mark.parametrize("n_dates,hot", [(60, 0), (20, 500), (1, 40), (3, 1)])
def test_cuts_equal_sorted_positions(spark, n_dates, hot):
    rows = rows_of(random.Random(n_dates), n_dates, hot)
    df = spark.createDataFrame(rows, "stock_code string, date date").repartition(4)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    n = len(order)
    train, val = int(n * 0.7), int(n * 0.8)
    assert labels(S.time_split(df), "split") == {r: "train" if i < train else "val" if i < val else "test" for i, r in enumerate(order)}
    assert labels(S.holdout_tail(df), "split") == {r: "base" if i < int(n * 0.8) else "meta" for i, r in enumerate(order)}
    sizes = [n // 5 + (j < n % 5) for j in range(5)]
    assert labels(S.contiguous_folds(df), "fold") == dict(zip(order, [j for j, size in enumerate(sizes) for _ in range(size)]))
    size = max(1, n // 6)
    want = {r: max(-1, (i - (n - 5 * size)) // size) for i, r in enumerate(order)}
    assert labels(S.expanding_blocks(df), "block") == want
    both = df.selectExpr("stock_code", "date", "'a' as model").unionByName(df.limit(7).selectExpr("stock_code", "date", "'b' as model"))
    assert labels(S.expanding_blocks(both, by=("model",)).where("model = 'a'"), "block") == want


def test_no_row_moves_for_a_split(spark):
    """The plan is one scan and a projection: no exchange, join or window over the rows."""
    df = spark.createDataFrame(rows_of(random.Random(1), 50, 100), "stock_code string, date date")
    for out in (S.time_split(df), S.contiguous_folds(df), S.holdout_tail(df), S.expanding_blocks(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Join", "Window", "Sort"))


def test_nulls_repeats_and_empty_table(spark):
    day = dt.date(2021, 1, 1)
    df = spark.createDataFrame([("a", day), ("b", day), ("b", day), ("c", day), (None, day), ("z", None)], "stock_code string, date date")
    got = sorted(((r.stock_code, r.date, r.split) for r in S.holdout_tail(df, 0.5).collect()), key=str)
    # by position null, a | b, b, c: equal rows stay together
    assert got == sorted([(None, day, "base"), ("a", day, "base"), ("b", day, "meta"), ("b", day, "meta"), ("c", day, "meta"), ("z", None, None)], key=str)
    assert S.time_split(df.limit(0)).count() == 0
