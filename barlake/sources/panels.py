"""Bar panels built from raw ticks (operator B1) and the gap grid (B2).

A bar is one row per ``(stock_code, date)`` bucket:
``open = min_by(price, order)``, ``high = max``, ``low = min``,
``close = max_by(price, order)``, ``volume``, ``amount``.

Scale notes. Every builder is one hash aggregate keyed by (instrument, bucket):
the partial aggregate runs map-side before the shuffle (min_by/max_by/sum/count
are all partial-capable), so a hot instrument holding a third of all ticks
only contributes one partial row per bucket per input split. Bucket values are
computed with calendar functions on TIMESTAMP_NTZ, independent of the session
time zone. Dimension joins (part, customer) are left to the planner: they are
equi-joins on keys with AQE, never forced broadcasts of data that grows with
the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.windows import KEY, TIME

BAR_COLUMNS = [KEY, TIME, "open", "high", "low", "close", "volume", "amount"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hour_bucket(ts) -> F.Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts),
                                F.lit(0), F.lit(0))


def ohlcv(ticks: DataFrame, instrument, bucket, price, order, volume, amount) -> DataFrame:
    """Generic tick → bar aggregation (B1)."""
    return (ticks
            .groupBy(instrument.alias(KEY), bucket.alias(TIME))
            .agg(F.min_by(price, order).alias("open"),
                 F.max(price).alias("high"),
                 F.min(price).alias("low"),
                 F.max_by(price, order).alias("close"),
                 F.sum(volume).cast("double").alias("volume"),
                 F.sum(amount).alias("amount")))


def event_bars(events: DataFrame) -> DataFrame:
    """Panel A: hourly bars per ``event_type``; ``events.ts`` is unique."""
    return ohlcv(events.where(F.col("value").isNotNull() & F.col("ts").isNotNull()),
                 F.col("event_type"), hour_bucket("ts"), F.col("value"), F.col("ts"),
                 F.lit(1), F.col("value"))


def brand_bars(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Panel B: weekly bars per part brand; price = extendedprice / quantity.

    lineitem rows are not unique on (orderkey, linenumber), so open/close use
    the full row as the ordering key; fully equal rows carry equal prices.
    """
    li = lineitem.where((F.col("l_quantity") > 0) & F.col("l_shipdate").isNotNull())
    j = li.join(part.select("p_partkey", "p_brand"), li.l_partkey == F.col("p_partkey"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    week = F.to_date(F.date_sub(F.to_date("l_shipdate"), F.weekday(F.to_date("l_shipdate"))))
    return ohlcv(j, F.col("p_brand"), week, price, order, F.col("l_quantity"),
                 F.col("l_extendedprice"))


def nation_bars(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Panel C: daily bars of order value per customer nation."""
    o = orders.where(F.col("o_orderdate").isNotNull() & F.col("o_totalprice").isNotNull())
    j = o.join(customer.select("c_custkey", "c_nationkey"), o.o_custkey == F.col("c_custkey"))
    return ohlcv(j, F.col("c_nationkey").cast("string"), F.to_date("o_orderdate"),
                 F.col("o_totalprice"), F.struct("o_orderdate", "o_orderkey"), F.lit(1),
                 F.col("o_totalprice"))


def supplier_bars(lineitem: DataFrame) -> DataFrame:
    """Panel D: monthly bars per supplier (many instruments)."""
    li = lineitem.where((F.col("l_quantity") > 0) & F.col("l_shipdate").isNotNull())
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    month = F.trunc(F.to_date("l_shipdate"), "month")
    return ohlcv(li, F.col("l_suppkey").cast("string"), month, price, order,
                 F.col("l_quantity"), F.col("l_extendedprice"))


PANELS = {
    "events": lambda spark, d: event_bars(table(spark, d, "events")),
    "brands": lambda spark, d: brand_bars(table(spark, d, "lineitem"), table(spark, d, "part")),
    "nations": lambda spark, d: nation_bars(table(spark, d, "orders"), table(spark, d, "customer")),
    "suppliers": lambda spark, d: supplier_bars(table(spark, d, "lineitem")),
}

# raw table, its time column and how far past the last bar start a tick can lie
_RAW = {"events": ("events", "ts", "1 day"), "brands": ("lineitem", "l_shipdate", "7 days"),
        "nations": ("orders", "o_orderdate", "1 day"), "suppliers": ("lineitem", "l_shipdate", "1 month")}


def load_panel(spark: SparkSession, sf_dir: str, panel: str = "events", start=None, end=None) -> DataFrame:
    """Bars of ``panel``; with ``start``/``end`` (dates of bar starts, inclusive)
    the raw ticks are range-filtered first, so the predicate reaches the
    Parquet scan (bucket expressions are not invertible by the optimizer)."""
    if start is None and end is None:
        return PANELS[panel](spark, sf_dir)
    name, tcol, span = _RAW[panel]
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(tcol) >= F.to_date(F.lit(start)).cast("timestamp_ntz"))
    if end is not None:
        cond = cond & (F.col(tcol) < (F.to_date(F.lit(end)) + F.expr(f"INTERVAL {span}")).cast("timestamp_ntz"))
    raw = table(spark, sf_dir, name).where(cond)
    if panel == "events":
        return event_bars(raw)
    if panel == "brands":
        return brand_bars(raw, table(spark, sf_dir, "part"))
    if panel == "nations":
        return nation_bars(raw, table(spark, sf_dir, "customer"))
    return supplier_bars(raw)


def gap_grid(bars: DataFrame, step: str = "1 hour") -> DataFrame:
    """B2: dense (instrument × bucket) grid with null OHLCV where no bar exists.

    The grid is built per instrument from its own first..last bucket with
    ``sequence`` + ``explode`` (no cross join, no driver round trip), then
    left-joined back to the bars on the full key. Its size is the number of
    buckets in each instrument's life, which bounds any gap-filled panel.
    """
    span = bars.groupBy(KEY).agg(F.min(TIME).alias("_lo"), F.max(TIME).alias("_hi"))
    grid = span.select(KEY, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step}")))
                       .alias(TIME))
    return grid.join(bars, [KEY, TIME], "left")
