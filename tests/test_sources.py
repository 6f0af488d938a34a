"""Readers, schema normalisation, validation and calendar helpers."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from barlake.sources import files as IO
from barlake.sources.panels import load_panel

from conftest import SF_SMALL


def test_csv_with_bom_and_localised_headers(spark, tmp_path):
    p = tmp_path / "bars.csv"
    p.write_text("﻿股票代码,日期,开盘,收盘,最高,最低,成交量\n"
                 "000001,2024-01-02,10,10.5,10.8,9.9,1000\n"
                 "000001,not-a-date,10,bad,10.8,9.9,1000\n", encoding="utf-8")
    df = IO.read_bars(spark, str(p))
    assert set(["stock_code", "date", "open", "close", "high", "low", "volume"]) <= set(df.columns)
    rows = df.orderBy(F.col("date").asc_nulls_last()).collect()
    assert rows[0].date == dt.date(2024, 1, 2) and rows[0].close == 10.5
    assert rows[1].date is None and rows[1].close is None


def test_vendor_english_headers(spark, tmp_path):
    p = tmp_path / "v.csv"
    p.write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,100\n")
    df = IO.read_bars(spark, str(p))
    assert {"date", "open", "high", "low", "close", "volume"} <= set(df.columns)


def test_validation_report(spark):
    bars = load_panel(spark, SF_SMALL)
    assert IO.is_valid(bars)
    bad = spark.createDataFrame([("a", None), ("b", None), ("c", 1.0)], "stock_code string, close double")
    r = IO.validation_report(bad).first()
    assert r.missing_columns == "date" and not r.valid


def test_zone_path():
    assert IO.zone_path("/d", "raw", "x.csv") == "/d/raw/x.csv"
    with pytest.raises(ValueError):
        IO.zone_path("/d", "elsewhere", "x.csv")


def test_missing_file_raises(spark):
    with pytest.raises(Exception):
        IO.read_bars(spark, "/nonexistent/file.parquet").count()


def test_weekday_fallback(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 6),), (dt.date(2024, 1, 7),), (dt.date(2024, 1, 8),)], "d date")
    out = [r[0] for r in df.select(IO.weekday_fallback("d")).collect()]
    assert out == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), dt.date(2024, 1, 8)]


@pytest.mark.parametrize("panel,start,end", [("events", "2024-01-05", "2024-01-12"),
                                             ("nations", "1996-03-01", "1996-06-30"),
                                             ("brands", "1996-03-04", "1996-06-24"),
                                             ("suppliers", "1996-03-01", "1996-06-01")])
def test_range_prefilter_equals_post_filter(spark, panel, start, end):
    """Pre-filtering raw ticks (scan pushdown) yields exactly the bars whose
    bucket starts in [start, end], for hour / day / week / month buckets."""
    def window(df):
        d = F.to_date("date")
        return df.where(d.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    a = window(load_panel(spark, SF_SMALL, panel, start, end)).orderBy("stock_code", "date").collect()
    b = window(load_panel(spark, SF_SMALL, panel)).orderBy("stock_code", "date").collect()
    assert len(a) == len(b) > 0
    assert a == b
