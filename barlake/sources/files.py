"""Bar-file readers, schema normalisation, validation and look-back scans.

Readers never infer schemas on the hot path and never swallow errors: a
missing file raises (``AnalysisException``) instead of returning None.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.windows import KEY, TIME

# Header rename map of vendor bar files (12 entries).
COLUMN_MAP = {
    "股票代码": "stock_code",
    "日期": "date",
    "开盘": "open",
    "收盘": "close",
    "最高": "high",
    "最低": "low",
    "成交量": "volume",
    "成交额": "amount",
    "振幅": "amplitude",
    "涨跌额": "change",
    "换手率": "turnover_rate",
    "涨跌幅": "change_rate",
}
# Numeric columns coerced to double, and the required columns.
NUMERIC = ["open", "high", "low", "close", "volume", "amount", "change_rate", "change",
           "turnover_rate", "amplitude"]
REQUIRED = ["stock_code", "date", "close"]

BAR_SCHEMA = T.StructType([
    T.StructField("stock_code", T.StringType()),
    T.StructField("date", T.DateType()),
    *[T.StructField(c, T.DoubleType()) for c in
      ("open", "close", "high", "low", "volume", "amount", "amplitude", "change",
       "turnover_rate", "change_rate")],
])

ZONES = ("raw", "processed", "external")


def zone_path(root: str, zone: str, filename: str) -> str:
    """``root/<zone>/<filename>``; an unknown zone is a ValueError."""
    if zone not in ZONES:
        raise ValueError(f"unsupported data zone: {zone}")
    return f"{root.rstrip('/')}/{zone}/{filename}"


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    """Format by extension (.csv / .parquet), default CSV.

    CSV is read as strings (or with ``schema``); a UTF-8 byte-order mark on the
    first header is stripped.
    """
    fmt = fmt or ("parquet" if path.endswith(".parquet") else "csv")
    if fmt == "parquet":
        return spark.read.parquet(path)
    r = spark.read.option("header", True).option("encoding", "UTF-8")
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path)
    first = df.columns[0] if df.columns else None
    if first and first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    return df


def standardize(df: DataFrame, daily: bool = True) -> DataFrame:
    """Rename vendor headers, coerce date and numerics (bad → null)."""
    df = df.withColumnsRenamed({k: v for k, v in COLUMN_MAP.items() if k in df.columns})
    # vendor files with capitalised English headers (Date, Close, ...)
    lower = {c: c.lower() for c in df.columns if c.lower() != c and c.lower() not in df.columns}
    df = df.withColumnsRenamed(lower)
    out = {}
    if TIME in df.columns:
        t = F.col(TIME).cast("string")
        ts = F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
        out[TIME] = F.to_date(ts) if daily else ts
    for c in NUMERIC:
        if c in df.columns:
            out[c] = F.col(c).cast("string").try_cast("double")
    if KEY in df.columns:
        out[KEY] = F.col(KEY).cast("string")
    return df.withColumns(out)


def read_bars(spark: SparkSession, path: str, fmt: str | None = None, daily: bool = True) -> DataFrame:
    """S1-S8 in one call."""
    return standardize(read_table(spark, path, fmt), daily)


def validation_report(df: DataFrame, max_null_ratio: float = 0.5) -> DataFrame:
    """One aggregate → (n_rows, missing_columns, close_null_ratio, valid)."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if "close" in df.columns:
        ratio = F.avg(F.when(F.col("close").isNull(), 1.0).otherwise(0.0))
    else:
        ratio = F.lit(None).cast("double")
    rep = df.agg(F.count(F.lit(1)).alias("n_rows"), ratio.alias("close_null_ratio"))
    return rep.select("n_rows", F.lit(",".join(missing)).alias("missing_columns"),
                      "close_null_ratio",
                      ((F.col("n_rows") > 0) & F.lit(not missing)
                       & (F.coalesce(F.col("close_null_ratio"), F.lit(1.0)) <= max_null_ratio)).alias("valid"))


def is_valid(df: DataFrame, max_null_ratio: float = 0.5) -> bool:
    return bool(validation_report(df, max_null_ratio).first()["valid"])


def dataset_summary(df: DataFrame, feature_cols: list[str] | None = None) -> DataFrame:
    """total_records, unique_stocks, date range, feature count."""
    feats = feature_cols if feature_cols is not None else [c for c in df.columns if c not in (KEY, TIME)]
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  F.countDistinct(KEY).alias("unique_stocks"),
                  F.min(TIME).alias("start_date"), F.max(TIME).alias("end_date"),
                  F.lit(len(feats)).cast("bigint").alias("feature_count"))


def load_bar_range(bars: DataFrame, universe: DataFrame | None, start, end,
                   fields: list[str] | None = None) -> DataFrame:
    """Range scan + universe semi join + field projection.

    The date predicate is on the scan column, so Parquet pushes it down; bars
    partitioned by year are pruned to the years of the range. The universe is joined
    with ``left_semi``: AQE broadcasts it when small, otherwise shuffles.
    """
    d = F.to_date(F.col(TIME))
    out = bars.where(d.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if "year" in bars.columns:  # written by save_bars: prunes its partitions
        out = out.where(F.col("year").between(F.year(F.to_date(F.lit(start))), F.year(F.to_date(F.lit(end)))))
    if universe is not None:
        out = out.join(universe.select(KEY).distinct(), KEY, "left_semi")
    if fields:
        out = out.select(KEY, TIME, *fields)
    return out


def load_index_series(bars: DataFrame, index_code: str, start, end) -> DataFrame:
    """Bars of one index code in a range."""
    return load_bar_range(bars.where(F.col(KEY) == index_code), None, start, end)


def constituents(table: DataFrame, code: str = "con_code", weight: str = "weight") -> DataFrame:
    """Distinct constituent codes with their weight."""
    return table.select(F.col(code).alias(KEY), F.col(weight).cast("double").alias(weight)).distinct()


def latest_trading_date(calendar: DataFrame, today=None, days: int = 10) -> DataFrame:
    """Newest open day (``is_open = 1``) within the last ``days`` days.

    ``today`` is a date string, a Column (e.g. a scalar subquery) or None
    for the current date."""
    if today is None:
        today = F.current_date()
    elif isinstance(today, str):
        today = F.to_date(F.lit(today))
    d = F.to_date(F.col("cal_date").cast("string"), "yyyyMMdd")
    return (calendar.where((F.col("is_open") == 1) & d.between(F.date_sub(today, days), today))
            .agg(F.max(d).alias("latest_trading_date")))


def weekday_fallback(d) -> F.Column:
    """A Saturday or Sunday rolls back to the previous Friday."""
    d = F.to_date(d if not isinstance(d, str) else F.col(d))
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))


def cached_stage(spark: SparkSession, df: DataFrame, root: str, name: str,
                 max_age_hours: float = 24.0) -> DataFrame:
    """Reuse ``root/name`` if younger than ``max_age_hours``, else rewrite it.

    ``root`` must be a shared folder (for example the session's checkpoint
    dir); the age comes from the files' own modification times.
    """
    path = f"{root.rstrip('/')}/{name}"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):  # a stage that was written whole
        stamp = (spark.read.parquet(path).select(F.max("_metadata.file_modification_time"))
                 .first()[0])
        if stamp is not None and time.time() - stamp.timestamp() <= max_age_hours * 3600:
            return spark.read.parquet(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clear_stage(spark: SparkSession, root: str, name: str | None = None) -> None:
    """Drop cached stages through the Hadoop file system (works on any store)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}" if name else root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def save_bars(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
              mode: str = "overwrite") -> None:
    """K1/K4/K8: write bars (Parquet partitioned by year by default; CSV on request)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
        return
    if partition_by is None and TIME in df.columns:
        # a year's rows meet in few tasks, so a year holds few files; adaptive execution splits the
        # tasks of a large year by size and joins up those of small ones
        df = df.withColumn("year", F.year(TIME)).hint("rebalance", F.col("year"))
        w = df.write.mode(mode)
        partition_by = ["year"]
    w.partitionBy(*(partition_by or [])).parquet(path)

