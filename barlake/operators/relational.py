"""Relational operators over panels (J1-J5, C1, A1, A2, G13) and universes.

As-of join (J5): ticks and bar ends are unioned and ordered inside (instrument, time bucket); what
a bucket enters with comes from a table of one row for each instrument and bucket. Bars may lie
anywhere in time (no grid), no range join, no cross product, and a hot instrument's ticks are
spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.windows import DEFAULT, KEY, TIME, PanelSpec
from barlake.operators.clean import apply_minmax, fit_minmax


def key_join(*frames: DataFrame, how: str = "inner", keys=(KEY, TIME)) -> DataFrame:
    """Features ⋈ predictions ⋈ prices on (instrument, time)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(keys), how)
    return out


def asof_join(left: DataFrame, right: DataFrame, left_key: str, left_time: str, right_key: str, right_time: str,
              carry: dict[str, str], bucket_seconds: int = 86400) -> DataFrame:
    """Every ``left`` row with the newest ``right`` row of its key at or before its time.

    ``carry`` maps columns of ``right`` to their names in the result (null where there is no such
    row). Rows with a null key or time find none. ``right`` holds one row for each key and
    time; times of any two types that cast to timestamp compare by instant."""
    def clock(c):
        return F.unix_micros(F.col(c).cast("timestamp")).alias("_t")

    found = F.struct(*[F.col(c).alias(n) for c, n in carry.items()])
    events = right.where(F.col(right_key).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(right_key).alias("_k"), clock(right_time), F.lit(0).alias("_kind"), found.alias("_found"))
    probes = left.select(F.col(left_key).cast(right.schema[right_key].dataType).alias("_k"), clock(left_time),
                         F.lit(1).alias("_kind"), F.struct("*").alias("_row"))
    bucket = F.floor(F.col("_t") / (bucket_seconds * 1_000_000)).alias("_b")
    both = probes.unionByName(events, allowMissingColumns=True).select("*", bucket)
    inside = Window.partitionBy("_k", "_b").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_in", F.last("_found", ignorenulls=True).over(inside)).where("_kind = 1")
    ends = both.groupBy("_k", "_b").agg(F.max_by("_found", F.when(F.col("_kind") == 0, F.col("_t"))).alias("_last"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    entering = ends.select(F.col("_k").alias("_ek"), F.col("_b").alias("_eb"), F.last("_last", ignorenulls=True).over(before).alias("_enter"))
    joined = seen.join(entering, (F.col("_k") == F.col("_ek")) & (F.col("_b") == F.col("_eb")), "left")
    best = F.coalesce("_in", "_enter")
    return joined.select("_row.*", *[best[n].alias(n) for n in carry.values()])


def asof_previous_bar(ticks: DataFrame, bars: DataFrame, key_col: str = "event_type",
                      ts_col: str = "ts", step: str = "1 hour") -> DataFrame:
    """Each tick with the newest bar that closed at or before it. ``step`` is the bars' length
    (an interval: hours, days, months); bars need not follow one another."""
    closed = bars.select(KEY, TIME, "close", (F.col(TIME) + F.expr(f"INTERVAL {step}")).alias("_closed"))
    return asof_join(ticks, closed, key_col, ts_col, KEY, "_closed", {TIME: "prev_bar_date", "close": "prev_close"})


def union_panels(frames: dict[str, DataFrame]) -> DataFrame:
    """Row-wise concatenation by name; columns missing in a source are null."""
    out = None
    for name, f in frames.items():
        f = f.withColumn("panel", F.lit(name))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def instrument_stats(bars: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """A1: per-instrument days, mean/std close, extremes and the last MA5."""
    with_ma = bars.withColumn("_ma5", spec.mean("close", 5))
    return with_ma.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("days"), F.avg("close").alias("mean_close"),
        F.stddev_samp("close").alias("std_close"), F.max("high").alias("max_high"),
        F.min("low").alias("min_low"), F.max_by("_ma5", TIME).alias("last_ma5"))


def coverage_rollup(bars: DataFrame) -> DataFrame:
    """A2: bar and instrument counts by (year, month) with subtotals."""
    d = F.to_date(TIME)
    return (bars.withColumns({"year": F.year(d), "month": F.month(d)})
            .rollup("year", "month")
            .agg(F.count(F.lit(1)).alias("bars"), F.countDistinct(KEY).alias("instruments")))


def region_universe(nation: DataFrame, region: DataFrame, customer: DataFrame, region_name: str) -> DataFrame:
    """S14 over dimension tables: nations of one region with their customer share."""
    nr = nation.join(region, nation.n_regionkey == region.r_regionkey).where(F.col("r_name") == region_name)
    cust = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("_c"))
    j = nr.join(cust, nr.n_nationkey == cust.c_nationkey, "left")
    # one row per nation of the region: a tiny table
    share = F.coalesce(F.col("_c"), F.lit(0)) / F.sum(F.coalesce(F.col("_c"), F.lit(0))).over(
        Window.partitionBy(F.lit(0)))
    return j.select(F.col("n_nationkey").cast("string").alias("con_code"), share.alias("weight"))


def trading_calendar(bars: DataFrame) -> DataFrame:
    """Calendar table (cal_date yyyyMMdd, is_open) over the panel's day range."""
    days = bars.select(F.to_date(TIME).alias("d")).distinct()
    span = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    allday = span.select(F.explode(F.sequence("lo", "hi")).alias("d"))
    return (allday.join(days.withColumn("_o", F.lit(1)), "d", "left")
            .select(F.date_format("d", "yyyyMMdd").alias("cal_date"),
                    F.coalesce(F.col("_o"), F.lit(0)).alias("is_open")))


def column_concat(*frames: DataFrame, keys=(KEY, TIME)) -> DataFrame:
    """Columns of several frames side by side, rows aligned by key (all rows of any frame);
    a column that an earlier frame has already is left out."""
    out = frames[0]
    for f in frames[1:]:
        new = [c for c in f.columns if c not in out.columns]
        out = out.join(f.select(*keys, *new), list(keys), "full")
    return out


def sequence_windows(df: DataFrame, features: list[str], label: str, length: int = 30,
                     spec: PanelSpec = DEFAULT, out: str = "sequence", scale: DataFrame | None = None) -> DataFrame:
    """The last ``length`` feature rows of each bar (per instrument) as an
    array of arrays, paired with the next bar's label; only full windows.

    ``scale`` (of :func:`clean.fit_minmax` over features and label) brings both to [0, 1]."""
    if scale is not None:
        df = apply_minmax(df, scale, list(dict.fromkeys([*features, label])))
    row = F.array(*[F.col(c).cast("double") for c in features])
    seq = F.collect_list(row).over(spec.trailing(length))
    return (df.withColumns({out: seq, "target": spec.lead(label)})
            .where((F.size(out) == length) & F.col("target").isNotNull()))


def sequence_scale(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Minimum and maximum of every feature and of the label, one row."""
    return fit_minmax(df, list(dict.fromkeys([*features, label])))


def latest_sequences(df: DataFrame, features: list[str], length: int = 30, spec: PanelSpec = DEFAULT,
                     out: str = "sequence", scale: DataFrame | None = None) -> DataFrame:
    """G13 when scoring: each instrument's newest ``length`` rows; an instrument with fewer has its
    last row ``length`` times. One row for each instrument, with the newest bar's keys."""
    if scale is not None:
        df = apply_minmax(df, scale, list(features))
    key, time = list(spec.keys), spec.order
    row = F.array(*[F.col(c).cast("double") for c in features])
    newest = Window.partitionBy(*key).orderBy(F.col(time).desc())
    last = df.select(*key, time, row.alias("_row"), F.row_number().over(newest).alias("_n")).where(F.col("_n") <= length)
    rows = F.transform(F.sort_array(F.collect_list(F.struct(time, "_row"))), lambda r: r["_row"])
    return (last.groupBy(*key).agg(F.max(time).alias(time), rows.alias("_rows"))
            .select(*key, time, F.size("_rows").cast("bigint").alias("n_rows"),
                    F.when(F.size("_rows") == length, F.col("_rows")).otherwise(
                        F.array_repeat(F.element_at("_rows", -1), length)).alias(out)))
