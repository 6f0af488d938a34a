"""Stateful operators that see an instrument's bars in time order, however they arrive.

Bars are held in the state store until the watermark passes them, an instrument's earliest one setting
its event-time timeout, and are then applied in time order: a bar that is late, but within the delay, changes nothing. A bar
behind the watermark can no longer be applied: it is put out with ``late = true`` and no values.
State of one instrument: the held bars (those of the delay), and what its indicator needs:
two averages for the RSI, the last bars for a look-back window. It does not grow with the stream.

State travels to the Python workers with the rows (``applyInPandasWithState``): one state for each key, in whatever
state store the session has, with no Python worker on the driver and no socket back to the executor's JVM.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barlake.functions.windows import KEY, TIME

BAR = ("open", "high", "low", "close", "volume")

# the classes of this module travel whole, so that a Python worker need not be able to import it
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class InOrder:
    """Holds rows ``(ms, us, values...)`` back until the watermark; subclasses apply them in order."""

    def __init__(self, columns: tuple[str, ...]):
        self.columns = columns

    #: schema of the indicator's own state, and the columns it puts out
    state_schema = ""

    def outputs(self) -> list[T.StructField]:
        raise NotImplementedError

    def apply(self, state: tuple | None, row: tuple) -> tuple[tuple, list]:
        """(state after the bar, output values) of the next bar in time order."""
        raise NotImplementedError

    def schema(self) -> str:
        """The state of an instrument: time of the last bar applied, bars held back, the indicator's own."""
        return f"upto bigint, held array<struct<ms bigint, us bigint, row array<double>>>, own struct<{self.state_schema}>"

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        names = [KEY, "_us", *self.columns, "late", *[f.name for f in self.outputs()]]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=names)

    def step(self, key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        upto, held, own = state.get if state.exists else (None, [], None)
        held = [tuple(r) for r in held]
        known = {r[0] for r in held}
        out = []
        for pdf in rows:
            for ms, us, *values in pdf.iloc[:, 2:].itertuples(index=False):  # by place: Spark names computed columns anew
                ms, us, values = int(ms), int(us), [float(v) for v in values]
                if ms <= mark or (upto is not None and ms <= upto) or ms in known:  # behind, or the bar of a time once more
                    out.append((us, *values, True, *[None] * len(self.outputs())))
                    continue
                known.add(ms)
                held.append((ms, us, values))
        held.sort(key=lambda r: r[0])
        ready = [r for r in held if r[0] <= mark]
        rest = held[len(ready):]
        own = own if own is None else tuple(own)
        for upto, us, values in ready:
            own, found = self.apply(own, tuple(values))
            out.append((us, *values, False, *found))
        state.update((upto, rest, own))
        if rest:  # a timeout must be positive; it is due once the watermark is beyond it
            state.setTimeoutTimestamp(max(rest[0][0] - 1, 1))
        if out:
            yield self._rows(key, out)


class WilderRsi(InOrder):
    """Wilder RSI(n): means of the first n gains and losses, then (mean * (n - 1) + new) / n; 0 when flat."""
    state_schema = "seen bigint, close double, gain double, loss double"

    def __init__(self, n: int):
        super().__init__(("close",))
        self.n = n

    def outputs(self):
        return [T.StructField(f"rsi_{self.n}", T.DoubleType())]

    def apply(self, state, row):
        close, n = row[0], self.n
        if state is None:
            return (0, close, 0.0, 0.0), [None]
        seen, before, gain, loss = state
        up, down = max(close - before, 0.0), max(before - close, 0.0)
        seen += 1  # changes so far; sums until there are n of them, means from then on
        if seen < n:
            return (seen, close, gain + up, loss + down), [None]
        if seen == n:
            gain, loss = (gain + up) / n, (loss + down) / n
        else:
            gain, loss = (gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n
        total = gain + loss
        return (seen, close, gain, loss), [0.0 if total < 1e-8 else 100.0 * gain / total]


class Ema(InOrder):
    """EMA(n) seeded by the mean of the first n closes."""
    state_schema = "seen bigint, ema double"

    def __init__(self, n: int):
        super().__init__(("close",))
        self.n = n

    def outputs(self):
        return [T.StructField(f"ema_{self.n}", T.DoubleType())]

    def apply(self, state, row):
        seen, ema = (0, 0.0) if state is None else state
        seen += 1
        if seen < self.n:
            return (seen, ema + row[0]), [None]
        a = 2.0 / (self.n + 1)
        ema = (ema + row[0]) / self.n if seen == self.n else a * row[0] + (1 - a) * ema
        return (seen, ema), [ema]


class LookBack(InOrder):
    """The last ``length`` bars up to and with each bar, oldest first, as arrays of numbers."""
    state_schema = "ring array<array<double>>"

    def __init__(self, length: int):
        super().__init__(BAR)
        self.length = length

    def outputs(self):
        return [T.StructField("window", T.ArrayType(T.ArrayType(T.DoubleType())))]

    def apply(self, state, row):
        ring = [list(map(float, r)) for r in state[0]] if state is not None else []
        ring = [*ring, list(row)][-self.length:]
        return (ring,), [ring]


def in_order(bars: DataFrame, processor: InOrder, delay: str) -> DataFrame:
    """Applies ``processor`` to a stream of bars (``stock_code``, ``date``, values; extra columns are
    dropped): their key, date and values, ``late`` and its outputs. Bars without a key, date or
    any of the values are left out; of several bars of one time the first that arrives counts,
    the others are late."""
    there = F.col(KEY).isNotNull() & F.col(TIME).isNotNull()
    for c in processor.columns:
        there = there & F.col(c).isNotNull()
    # a row of its own tells the watermark a bar's time and ends there; the bar itself has no event time, which
    # would make Spark drop it behind the watermark: its times travel as plain numbers
    at, none = F.col(TIME).cast("timestamp"), F.lit(None).cast("timestamp")
    stamped = bars.where(there).withColumn("_event", F.explode(F.array(at, none))).withWatermark("_event", delay).where(F.col("_event").isNull())
    rows = stamped.select("_event", F.col(KEY).cast("string").alias(KEY), F.unix_millis(at).alias("_ms"), F.unix_micros(at).alias("_us"),
                          *[F.col(c).cast("double").alias(c) for c in processor.columns])
    schema = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("_us", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in processor.columns],
                           T.StructField("late", T.BooleanType()), *processor.outputs()])
    out = rows.groupBy(KEY).applyInPandasWithState(processor.step, schema, processor.schema(), "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(KEY, F.timestamp_micros("_us").cast("timestamp_ntz").alias(TIME), *[f.name for f in schema.fields if f.name not in (KEY, "_us")])


def stream_rsi(bars: DataFrame, n: int = 14, delay: str = "1 day") -> DataFrame:
    """Z3: streaming Wilder RSI(n) of the closes."""
    return in_order(bars, WilderRsi(n), delay)


def stream_ema(bars: DataFrame, n: int = 10, delay: str = "1 day") -> DataFrame:
    """Z3: streaming EMA(n) of the closes, seeded by the mean of the first n."""
    return in_order(bars, Ema(n), delay)


def stream_windows(bars: DataFrame, length: int, delay: str = "1 day") -> DataFrame:
    """Each bar with its instrument's last ``length`` bars, kept in the state store."""
    return in_order(bars, LookBack(length), delay)


def back(column: str, age: int = 0) -> Column:
    """A value of the bar ``age`` bars ago in ``window``; null before the first bar."""
    return F.try_element_at("window", F.lit(-1 - age))[BAR.index(column)]


def back_mean(column: str, n: int) -> Column:
    """Mean over the last n bars of ``window``; null while there are fewer."""
    i = BAR.index(column)
    total = F.aggregate(F.slice("window", -n, n), F.lit(0.0), lambda a, r: a + r[i])
    return F.when(F.size("window") >= n, total / n)


def score_stream(bars: DataFrame, model, features: dict[str, Column], length: int, delay: str = "1 day",
                 out: str = "predicted_return") -> DataFrame:
    """``model`` applied to features of each bar's look-back window (expressions over
    :func:`back` and :func:`back_mean`), as one streaming plan: no buffer tables, no foreachBatch."""
    from barlake.operators import models as M

    windows = stream_windows(bars, length, delay)
    ready = windows.where("not late").withColumns(features)
    return M.predict(model, ready, out, keep=[KEY, TIME, "close"])
