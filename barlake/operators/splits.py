"""Dataset splits, folds and labels (M1-M9).

A split in (time, key) order needs no positions, only the bars at which its parts begin:
:func:`cut_points` finds them from per-time row counts and ranks rows only inside the times that a
cut falls into. Rows are then labelled by comparing them with these few bars. Random splits and shuffled folds use a seeded
md5 of the row key: deterministic, independent of partitioning and
of executor retries (``randomSplit`` is neither).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.windows import DEFAULT, KEY, TIME, PanelSpec, div
from barlake.session import written

SPLIT = "split"


def next_return_label(df: DataFrame, price: str = "close", out: str = "target_return_1d",
                      horizon: int = 1, spec: PanelSpec = DEFAULT) -> DataFrame:
    """M9: the label is the next bar's return, p[t+h] / p[t] - 1."""
    return df.withColumn(out, div(spec.lead(price, horizon), price) - 1)


def cut_points(df: DataFrame, cuts: Callable[[Column], list[Column]], time: str = TIME, key: str = KEY,
               by: tuple = (), prefix: int = 4) -> DataFrame:
    """``(*by, cut, time, key)``: the bar at position ``cuts(n)[cut]`` of each group in (time, key)
    order, n being its rows. A null key means the first bar of that time; cuts at or behind n
    have no row, cuts below 0 are at 0.

    Rows of the times that hold a cut are counted by the first ``prefix`` characters of their key
    (a string), and only those of one prefix are ranked, so a time with a large share of the
    rows is not sorted in one task. Rows equal in time and key stay together, behind the cut.
    """
    by = list(by)
    timed = df.where(F.col(time).isNotNull()).select(*by, time, key)
    group = Window.partitionBy(*(by or [F.lit(0)]))
    per = timed.groupBy(*by, time).agg(F.count("*").alias("_c"))
    per = per.withColumns({"_end": F.sum("_c").over(group.orderBy(time)), "_n": F.sum("_c").over(group)})
    at = F.array(*[F.greatest(c.cast("bigint"), F.lit(0).cast("bigint")) for c in cuts(F.col("_n"))])
    points = per.select(*by, time, "_c", "_end", F.posexplode(at).alias("cut", "_at"))
    points = points.withColumn("_off", F.col("_at") - F.col("_end") + F.col("_c")).where("_off >= 0 and _off < _c")
    points = written(points.select(*by, time, "cut", "_off"), "cuts")
    inside = points.where("_off > 0")
    if by:
        if not inside.limit(1).count():
            return points.select(*by, "cut", time, F.lit(None).cast(df.schema[key].dataType).alias(key))
        rows = timed.join(F.broadcast(inside.select(*by, time).distinct()), [*by, time])  # a row for each group and cut
    else:
        times = [r[0] for r in inside.select(time).distinct().collect()]
        if not times:
            return points.select("cut", time, F.lit(None).cast(df.schema[key].dataType).alias(key))
        rows = timed.where(F.col(time).isin(times))
    sub = F.substring(key, 1, prefix) if isinstance(df.schema[key].dataType, T.StringType) else F.lit("")
    rows = rows.withColumn("_sub", sub)
    cell = [*by, time, "_sub"]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("_m"))
    cells = cells.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*by, time).orderBy("_sub")))
    chosen = inside.join(cells, [*by, time]).where("_off < _upto and _off >= _upto - _m")
    chosen = written(chosen.select(*cell, "cut", (F.col("_off") - F.col("_upto") + F.col("_m") + 1).alias("_rank")), "cells")
    # a row or two for each cut: the cells to rank, then the rows wanted of them
    wanted = chosen.select(*[F.col(c).alias(f"_c_{c}") for c in cell], F.col("_rank").alias("_c__rank"), F.col("cut"))

    def same(*names):
        on = F.lit(True)
        for c in names:
            on = on & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
        return on

    ranked = rows.join(F.broadcast(wanted.drop("_c__rank", "cut").distinct()), same(*cell), "left_semi")
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy(key)))
    at_key = ranked.join(F.broadcast(wanted), same(*cell, "_rank")).select(*by, time, key, "cut")
    return points.join(F.broadcast(at_key), [*by, time, "cut"], "left").select(*by, "cut", time, key)


def cut_blocks(df: DataFrame, cuts: Callable[[Column], list[Column]], out: str, time: str = TIME, key: str = KEY,
               by: tuple = ()) -> DataFrame:
    """Rows with the number of cuts at or before them, in (time, key) order of their ``by`` group.

    One scan for the row counts, one of the few times that hold a cut, then a projection: rows are
    neither moved nor copied. Rows without a time get null."""
    points = written(cut_points(df, cuts, time, key, by), "points")
    t, k = F.col(time), F.col(key)
    if by:  # a row for each group: as many as the predictions have models
        bars = points.groupBy(*by).agg(F.collect_list(F.struct(F.col(time).alias("t"), F.col(key).alias("k"))).alias("_cuts"))
        passed = F.size(F.filter("_cuts", lambda c: (t > c["t"]) | ((t == c["t"]) & (c["k"].isNull() | (k >= c["k"])))))
        out_df = df.join(F.broadcast(bars), list(by), "left").withColumn(out, F.when(t.isNotNull(), F.coalesce(passed, F.lit(0))))
        return out_df.drop("_cuts")
    passed = F.lit(0)
    kinds = {c: df.schema[c].dataType for c in (time, key)}
    for _, at, first in points.collect():  # one row for each cut
        at, first = F.lit(at).cast(kinds[time]), first if first is None else F.lit(first).cast(kinds[key])
        passed = passed + (F.when(t >= at, 1) if first is None else F.when((t > at) | ((t == at) & (k >= first)), 1)).otherwise(0)
    return df.withColumn(out, F.when(t.isNotNull(), passed))


def _named(block: str, *names: str) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.col(block))


def time_split(df: DataFrame, test_size: float = 0.2, val_size: float = 0.1,
               time: str = TIME, key: str = KEY) -> DataFrame:
    """M1: first int(n(1-t-v)) rows train, up to int(n(1-t)) val, rest test."""
    cut = cut_blocks(df, lambda n: [F.floor(n * (1 - test_size - val_size)), F.floor(n * (1 - test_size))], "_block", time, key)
    return cut.withColumn(SPLIT, _named("_block", "train", "val", "test")).drop("_block")


def hash_int(keys: list[str], seed: int = 42) -> F.Column:
    """32 bits of the md5 of seed and row key: any engine computes the same."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_unit(keys: list[str], seed: int = 42) -> F.Column:
    """Deterministic pseudo-uniform in [0, 1) from the row key and a seed."""
    return F.pmod(hash_int(keys, seed), F.lit(1_000_000)) / 1e6


def random_split(df: DataFrame, test_size: float = 0.2, val_size: float = 0.1, seed: int = 42,
                 keys=(KEY, TIME)) -> DataFrame:
    """M2: test share t, then val = v / (1 - t) of the remainder (overall v)."""
    u = hash_unit(list(keys), seed)
    label = (F.when(u < test_size, "test").when(u < test_size + val_size, "val").otherwise("train"))
    return df.withColumn(SPLIT, label)


def shuffled_folds(df: DataFrame, k: int = 5, seed: int = 42, keys=(KEY, TIME), out: str = "fold") -> DataFrame:
    """M3: fold id in 0..k-1 from a seeded hash (for CrossValidator(foldCol=...))."""
    return df.withColumn(out, F.pmod(hash_int(list(keys), seed + 1), F.lit(k)).cast("int"))


def contiguous_folds(df: DataFrame, k: int = 5, time: str = TIME, key: str = KEY, out: str = "fold") -> DataFrame:
    """M5: unshuffled k folds in time order; the first n mod k folds get one extra row."""
    return cut_blocks(df, lambda n: [F.floor(n / k) * j + F.least(n % k, F.lit(j)) for j in range(1, k)], out, time, key)


def expanding_blocks(df: DataFrame, k: int = 5, time: str = TIME, key: str = KEY, out: str = "block", by: tuple = ()) -> DataFrame:
    """M4 without copies: the test block 0..k-1 a row is in, -1 before the first. Fold f tests
    ``block = f`` on a model of ``block < f``; test blocks have n // (k + 1) rows."""
    def cuts(n):
        size = F.greatest(F.floor(n / (k + 1)), F.lit(1))
        return [n - size * (k - j) for j in range(k)]
    return cut_blocks(df, cuts, out, time, key, by).withColumn(out, F.col(out) - 1)


def fold_roles(blocks: DataFrame, k: int = 5, block: str = "block", time: str = TIME) -> DataFrame:
    """M4: rows and first and last time of every fold's train and test part, from one count for
    each block: k + 1 rows are combined, no row of the data is copied."""
    per = blocks.groupBy(F.col(block).alias("_b")).agg(F.count("*").alias("_n"), F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    per = per.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("_b <= fold")
    role = F.when(F.col("_b") < F.col("fold"), "train").otherwise("test").alias("role")
    return per.groupBy("fold", role).agg(F.sum("_n").alias("n"), F.min("_lo").alias("first_date"), F.max("_hi").alias("last_date"))


def holdout_tail(df: DataFrame, frac: float = 0.8, time: str = TIME, key: str = KEY) -> DataFrame:
    """M6: first int(n·frac) rows 'base', the rest 'meta' (blending hold-out)."""
    cut = cut_blocks(df, lambda n: [F.floor(n * frac)], "_block", time, key)
    return cut.withColumn(SPLIT, _named("_block", "base", "meta")).drop("_block")


def cv_summary(fold_metrics: DataFrame, by=("model",), metrics=("mse", "rmse", "mae", "r2")) -> DataFrame:
    """M7: mean and population std of each metric over folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return fold_metrics.groupBy(*by).agg(*aggs)


def cv_score(fold_metrics: DataFrame, by=("model",)) -> DataFrame:
    """M8: mse mean/std; rmse = sqrt(mean mse); rmse_std = sqrt(std mse) (kept as named)."""
    a = fold_metrics.groupBy(*by).agg(F.avg("mse").alias("mse_mean"), F.stddev_pop("mse").alias("mse_std"))
    return a.withColumns({"rmse": F.sqrt("mse_mean"), "rmse_std": F.sqrt("mse_std")})


def fold_metrics(pred: DataFrame, y: str = "y", p: str = "p", by=("model", "fold")) -> DataFrame:
    """Per-fold mse, rmse, mae, r2 from long predictions with a fold column."""
    e = F.col(y) - F.col(p)
    a = pred.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                              F.var_pop(y).alias("_vy"))
    return a.withColumns({"rmse": F.sqrt("mse"), "r2": 1 - F.try_divide(F.col("mse"), F.col("_vy"))}).drop("_vy")
