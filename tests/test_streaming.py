"""Stateful streams against batch results: order of arrival, late bars, restarts."""
import datetime as dt
import os
import random
import subprocess
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle

import sequential as Q
from barlake.streaming import bars as ZB
from barlake.streaming import ordered as ZO

START = dt.datetime(2024, 1, 1)
SCHEMA = "stock_code string, date timestamp_ntz, open double, high double, low double, close double, volume double"


def made(rng, keys=("a", "b"), n=60):
    return [(k, START + dt.timedelta(hours=i), 1.0, 2.0 + i, 0.5, 10 + rng.random(), float(i)) for k in keys for i in range(n)]


def run(spark, batches, make, root, restart=False):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        if restart or i == len(batches) - 1:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
            ZB.run_to_folder(make(stream), f"{root}/out", f"{root}/ck")
    return spark.read.parquet(f"{root}/out").toPandas()


@pytest.mark.parametrize("restart", [False, True])
def test_rsi_does_not_depend_on_the_order_of_arrival(spark, tmp_path, restart):
    rng = random.Random(3)
    rows = made(rng)
    held = [r for r in rows if 30 <= r[1].hour + 24 * (r[1].day - 1) < 40 and r[1].hour % 3 == 0]
    first = [r for r in rows if r[1] < START + dt.timedelta(hours=40) and r not in held]
    second = [r for r in rows if r not in first]
    rng.shuffle(first)
    rng.shuffle(second)
    late = [("a", START + dt.timedelta(hours=2), 1.0, 1.0, 1.0, 99.0, 1.0), ("a", None, 1.0, 1.0, 1.0, 1.0, 1.0), (None, START, 1.0, 1.0, 1.0, 1.0, 1.0)]
    got = run(spark, [first, second, late], lambda s: ZO.stream_rsi(s, 5, "12 hours"), tmp_path, restart)
    assert got[got.late][["stock_code", "close", "rsi_5"]].values.tolist()[0][:2] == ["a", 99.0] and got.late.sum() == 1
    ok = got[~got.late]
    assert ok.date.max() <= pd.Timestamp(START + dt.timedelta(hours=47)) and len(ok) >= 2 * 47
    for k in ("a", "b"):
        part = ok[ok.stock_code == k].sort_values("date")
        closes = pd.Series([r[5] for r in rows if r[0] == k])
        want = Q.rsi_wilder(closes.to_numpy(), 5)[:len(part)]
        pd.testing.assert_series_equal(part.rsi_5.reset_index(drop=True), pd.Series(want, name="rsi_5"))


def test_windows_keep_the_last_bars_only(spark, tmp_path):
    rows = made(random.Random(1), n=30)
    got = run(spark, [rows[::2], rows[1::2]], lambda s: ZO.stream_windows(s, 4, "40 hours"), tmp_path)
    assert len(got) == 0 or not got.late.any()
    got = run(spark, [made(random.Random(1), n=100)], lambda s: ZO.stream_windows(s, 4, "1 hour"), tmp_path / "b")
    a = got[(got.stock_code == "a") & ~got.late].sort_values("date")
    assert [len(w) for w in a.window[:6]] == [1, 2, 3, 4, 4, 4]
    assert [r[4] for r in a.window.iloc[10]] == [7.0, 8.0, 9.0, 10.0]


@pytest.mark.parametrize("name", ["stream_ema", "stream_rsi", "stream_windows", "stream_scores"])
def test_queries_run_in_a_session_with_sparks_own_state_store(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as E
    key, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    rng = random.Random(5)
    ticks = [(i, START + dt.timedelta(minutes=30 * i), 1, "ab"[i % 3 > 0], 10 + round(rng.random(), 3), "") for i in range(960)]
    spark.createDataFrame(ticks, ZB.TICK_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    plain = spark.newSession()
    plain.conf.set(key, own)
    df = E.queries()[name](plain, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(E.oracle_sql()[name]).fetchall()
    assert len(want) > 500 and sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))
    assert plain.conf.get(key) == own


def test_operators_run_on_sparks_own_state_store(spark, tmp_path):
    plain = spark.newSession()
    plain.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    bar = lambda k, h, close: (k, START + dt.timedelta(hours=h), 1.0, 2.0, 0.5, close, 1.0)
    first = [bar("a", 2, 3.0), bar("a", 0, 1.0), bar("c", 3, 5.0), bar("b", 5, 8.0)]
    second = [bar("a", 1, 2.0), bar("a", 2, 9.0), bar("a", 4, 4.0)]  # behind the watermark of hour 3; again; in time
    got = run(plain, [first, second], lambda s: ZO.stream_ema(s, 2, "2 hours"), tmp_path)
    rows = sorted((r.stock_code, (r.date - START).total_seconds() / 3600, r.close, bool(r.late), r.ema_2) for r in got.itertuples())
    assert str(rows) == str([("a", 0.0, 1.0, False, float("nan")), ("a", 1.0, 2.0, True, float("nan")), ("a", 2.0, 3.0, False, 2.0),
                             ("a", 2.0, 9.0, True, float("nan")), ("c", 3.0, 5.0, False, float("nan"))])  # c's only bar lies at the watermark
    old = [(k, d.replace(year=1969), *r) for k, d, *r in first]  # before the clock's zero a bar is late, not an error
    assert run(plain, [old], lambda s: ZO.stream_ema(s, 2, "2 hours"), tmp_path / "old").late.all()


@pytest.mark.parametrize("processor", [ZO.WilderRsi(5), ZO.Ema(5), ZO.LookBack(5)])
def test_processors_load_where_the_package_is_not_importable(tmp_path, processor):
    (tmp_path / "p").write_bytes(cloudpickle.dumps(processor))
    code = "import pickle, sys; p = pickle.load(open('p', 'rb')); print(len(p.outputs()), 'barlake' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert done.stdout.split() == ["1", "False"], done.stderr
