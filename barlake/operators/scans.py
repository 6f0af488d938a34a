"""Recursive indicators in block form: a long instrument is many tasks.

A panel's instruments are cut into time blocks of about ``block_rows`` bars. What one block
must know of all bars before it is a small state vector, found without reading those bars in
one task:

* **Linear recursions** (EMA, EWM, TEMA, MACD, Wilder RSI / ATR / ADX) are affine in their
  state, ``exit = M * enter + v`` with one matrix for each block: ``v`` is the block run from a
  zero state, ``M`` a matrix power of its length. The first pass writes one such row for each
  block; the rows of an instrument are composed in time order, which gives every block its
  entering state. A recursion over a non-linear function of another one (the ADX over DX, the
  MACD signal over adjusted averages) is a second stage, composed after the first is known.
* **State machines** (parabolic SAR, the Hilbert cycle) have no such map. Every block is first
  run from the state that its predecessor's last bars suggest; blocks whose entering
  state proves to differ from the one they were run with are run again, until none does. A round
  settles at least one more block, so the result is exact; machines forget, so it takes few.

A last pass computes each block's rows from its states, vectorised inside the block: a decay
``y = q * y + u`` is a product with a small triangular matrix and a decay over the chunks' ends.
Where no instrument has more than one block the last pass is the only one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.windows import PanelSpec
from barlake.session import written

BLOCK = "_blk"
EPS = 1e-8
CHUNK = 32


def decay(u: np.ndarray, q: float, y0: float) -> np.ndarray:
    """y[t] = q * y[t-1] + u[t] with y[-1] = y0; everything from the first NaN on is NaN."""
    n = len(u)
    bad = np.flatnonzero(np.isnan(u))
    if len(bad) or math.isnan(y0):
        good = 0 if math.isnan(y0) else int(bad[0])
        return np.concatenate([decay(u[:good], q, y0) if good else u[:0], np.full(n - good, np.nan)])
    if n <= CHUNK:
        out, y = np.empty(n), y0
        for t, x in enumerate(u.tolist()):
            y = q * y + x
            out[t] = y
        return out
    rows = -(-n // CHUNK)
    age = np.arange(CHUNK)
    table = np.zeros(rows * CHUNK)
    table[:n] = u
    local = table.reshape(rows, CHUNK) @ np.tril(q ** np.maximum(age[:, None] - age[None, :], 0.0)).T
    ends = decay(local[:, -1], q ** CHUNK, y0)
    carried = np.concatenate([[y0], ends[:-1]])[:, None] * q ** (age + 1.0)
    return (local + carried).reshape(-1)[:n]


class Bars:
    """Bars of one block in time order, and the bar before them (None: the instrument begins here)."""

    def __init__(self, pdf: pd.DataFrame, prev: tuple[float, float, float] | None):
        for c in ("high", "low", "close"):
            values = pdf[c].to_numpy(dtype="float64", na_value=np.nan) if c in pdf.columns else np.full(len(pdf), np.nan)
            setattr(self, c, values)
        self.prev, self.n = prev, len(pdf)

    def lagged(self, c: str) -> np.ndarray:
        first = np.nan if self.prev is None else self.prev[("high", "low", "close").index(c)]
        return np.concatenate([[first], getattr(self, c)[:-1]]) if self.n else np.zeros(0)


def _averaged(x: np.ndarray, n: int, enter: float | None, start: int | None = None, seed_at: int | None = None) -> np.ndarray:
    """EMA of span n: from the entering state, or seeded by the mean of n values that end at `seed_at`
    (by default of the first n from `start`, or from the first value there is)."""
    a = 2.0 / (n + 1)
    if enter is not None:
        return decay(a * x, 1 - a, enter)
    out = np.full(len(x), np.nan)
    if start is None:
        valid = np.flatnonzero(~np.isnan(x))
        start = int(valid[0]) if len(valid) else len(x)
    at = start + n - 1 if seed_at is None else seed_at
    if at < len(x) and at - n + 1 >= 0:
        out[at] = x[at - n + 1:at + 1].mean()
        out[at + 1:] = decay(a * x[at + 1:], 1 - a, out[at])
    return out


def _wilder(u: np.ndarray, n: int, enter: float | None) -> np.ndarray:
    """Mean of u[1..n] at n, then y = (y * (n - 1) + u) / n; or that from the entering state."""
    if enter is not None:
        return decay(u / n, (n - 1) / n, enter)
    out = np.full(len(u), np.nan)
    if len(u) > n:
        out[n] = u[1:n + 1].mean()
        out[n + 1:] = decay(u[n + 1:] / n, (n - 1) / n, out[n])
    return out


def _last(*series: np.ndarray) -> np.ndarray:
    return np.array([s[-1] for s in series])


def _ranges(b: Bars) -> np.ndarray:
    c = b.lagged("close")
    return np.maximum.reduce([b.high - b.low, np.abs(b.high - c), np.abs(b.low - c)])


# -- linear recursions: scan(stage, bars, series, enter) -> exit, matrix(stage, bars, series) --------

class Ema:
    stages = 1

    def __init__(self, n: int, ratio: bool = False):
        self.n, self.ratio = n, ratio

    def scan(self, stage, b, series, enter):
        series["y"] = _averaged(b.close, self.n, None if enter is None else enter[0])
        return _last(series["y"])

    def size(self, stage):
        return 1

    def matrix(self, stage, b, series):
        return np.array([[(1 - 2.0 / (self.n + 1)) ** b.n]])

    def outputs(self, b, series):
        y = series["y"]
        out = {f"ema_{self.n}": y}
        if self.ratio:
            with np.errstate(divide="ignore", invalid="ignore"):
                out[f"price_ema_{self.n}_ratio"] = np.where(y != 0, b.close / y, np.nan)
        return out


class Tema:
    stages, n = 1, 30

    def scan(self, stage, b, series, enter):
        x, found = b.close, []
        for i in range(3):
            x = _averaged(x, self.n, None if enter is None else enter[i])
            found.append(x)
        series["e"] = found
        return _last(*found)

    def size(self, stage):
        return 3

    def matrix(self, stage, b, series):
        a = 2.0 / (self.n + 1)
        q = 1 - a
        return np.linalg.matrix_power(np.array([[q, 0, 0], [a * q, q, 0], [a * a * q, a * q, q]]), b.n)

    def outputs(self, b, series):
        one, two, three = series["e"]
        return {"tema": 3 * one - 3 * two + three}


class MacdSeeded:
    stages, fast, slow, signal = 1, 12, 26, 9

    def scan(self, stage, b, series, enter):
        first = self.slow - 1
        if enter is None:
            slow = _averaged(b.close, self.slow, None, start=0)
            fast = _averaged(b.close, self.fast, None, seed_at=first)
            line = fast - slow
            signal = _averaged(line, self.signal, None, start=first)
            line[:first + self.signal - 1] = np.nan
        else:
            fast, slow = _averaged(b.close, self.fast, enter[0]), _averaged(b.close, self.slow, enter[1])
            line = fast - slow
            signal = _averaged(line, self.signal, enter[2])
        series["line"], series["signal"] = line, signal
        return _last(fast, slow, signal)

    def size(self, stage):
        return 3

    def matrix(self, stage, b, series):
        f, s, g = (2.0 / (n + 1) for n in (self.fast, self.slow, self.signal))
        return np.linalg.matrix_power(np.array([[1 - f, 0, 0], [0, 1 - s, 0], [g * (1 - f), -g * (1 - s), 1 - g]]), b.n)

    def outputs(self, b, series):
        return {"macd": series["line"], "macd_signal": series["signal"], "macd_histogram": series["line"] - series["signal"]}


class EwmMacd:
    """Weighted means over all bars so far (numerator and denominator decay); the signal is a second stage."""
    stages, spans = 2, ((12, 26), (9,))

    def scan(self, stage, b, series, enter):
        x = b.close if stage == 0 else series["macd"]
        there, exits, means = ~np.isnan(x), [], []
        for i, n in enumerate(self.spans[stage]):
            q = 1 - 2.0 / (n + 1)
            y0 = (0.0, 0.0) if enter is None else enter[2 * i:2 * i + 2]
            num = decay(np.where(there, x, 0.0), q, y0[0])
            den = decay(there.astype(float), q, y0[1])
            with np.errstate(divide="ignore", invalid="ignore"):
                means.append(np.where(den > 0, num / den, np.nan))
            exits += [num[-1], den[-1]]
        series["macd" if stage == 0 else "signal"] = means[0] - means[1] if stage == 0 else means[0]
        return np.array(exits)

    def size(self, stage):
        return 2 * len(self.spans[stage])

    def matrix(self, stage, b, series):
        return np.diag([(1 - 2.0 / (n + 1)) ** b.n for n in self.spans[stage] for _ in range(2)])

    def outputs(self, b, series):
        return {"macd": series["macd"], "macd_signal": series["signal"], "macd_histogram": series["macd"] - series["signal"]}


class Rsi:
    stages = 1

    def __init__(self, n: int, name: str):
        self.n, self.name = n, name

    def scan(self, stage, b, series, enter):
        d = b.close - b.lagged("close")
        gain, loss = (_wilder(np.where(s * d > 0, s * d, 0.0), self.n, None if enter is None else enter[i]) for i, s in enumerate((1, -1)))
        series["gain"], series["loss"] = gain, loss
        return _last(gain, loss)

    def size(self, stage):
        return 2

    def matrix(self, stage, b, series):
        return np.eye(2) * ((self.n - 1) / self.n) ** b.n

    def outputs(self, b, series):
        total = series["gain"] + series["loss"]
        with np.errstate(divide="ignore", invalid="ignore"):
            return {self.name: np.where(np.abs(total) < EPS, 0.0, 100.0 * series["gain"] / total)}


class Atr:
    stages = 1

    def __init__(self, n: int):
        self.n = n

    def scan(self, stage, b, series, enter):
        series["y"] = _wilder(_ranges(b), self.n, None if enter is None else enter[0])
        return _last(series["y"])

    def size(self, stage):
        return 1

    def matrix(self, stage, b, series):
        return np.array([[((self.n - 1) / self.n) ** b.n]])

    def outputs(self, b, series):
        return {f"atr_{self.n}": series["y"]}


class Adx:
    """Decayed sums of directional moves and true range; the ADX smooths DX in a second stage.
    Bars whose DX is undefined (no range, no movement) leave the ADX as it was."""
    stages, n = 2, 14

    def scan(self, stage, b, series, enter):
        n, q = self.n, (self.n - 1) / self.n
        if stage == 0:
            up, down = b.high - b.lagged("high"), b.lagged("low") - b.low
            minus = np.where((down > 0) & (up < down), down, 0.0)
            plus = np.where((up > 0) & (up > down), up, 0.0)
            sums = []
            for i, u in enumerate((plus, minus, _ranges(b))):
                if enter is not None:
                    sums.append(decay(u, q, enter[i]))
                    continue
                y = np.full(b.n, np.nan)
                if b.n >= n:
                    y[n - 1] = u[1:n].sum()
                    y[n:] = decay(u[n:], q, y[n - 1])
                sums.append(y)
            with np.errstate(divide="ignore", invalid="ignore"):
                pdi, mdi = 100 * sums[0] / sums[2], 100 * sums[1] / sums[2]
                series["dx"] = 100 * np.abs(mdi - pdi) / (mdi + pdi)
                series["ok"] = (np.abs(sums[2]) >= EPS) & (np.abs(mdi + pdi) >= EPS)
            return _last(*sums)
        dx, ok, out = series["dx"], series["ok"].copy(), np.full(b.n, np.nan)
        first, before = 0, np.nan
        if enter is None:
            if b.n < 2 * n:
                series["adx"] = out
                return _last(out)
            first = 2 * n - 1
            before = dx[n:2 * n][ok[n:2 * n]].sum() / n
            ok[:2 * n] = False
        else:
            before = enter[0]
        smooth = np.concatenate([[before], decay(dx[ok] / n, (n - 1) / n, before)])
        out[first:] = smooth[np.cumsum(ok)][first:]
        series["adx"] = out
        return _last(out)

    def size(self, stage):
        return (3, 1)[stage]

    def matrix(self, stage, b, series):
        q = (self.n - 1) / self.n
        return np.eye(3) * q ** b.n if stage == 0 else np.array([[q ** int(series["ok"].sum())]])

    def outputs(self, b, series):
        return {"adx": series["adx"]}


# -- state machines: guess(bars) -> state, run(bars, state) -> (outputs, exit state) -------------------

class Sar:
    """State: long?, acceleration, extreme, stop, low and high of the bar before."""
    accel, maximum = 0.02, 0.2

    def _begin(self, low0, high0, low1, high1):
        down, up = low0 - low1, high1 - high0
        long_ = not (down > 0 and up < down)
        return [float(long_), min(self.accel, self.maximum), high1 if long_ else low1, low0 if long_ else high0, low1, high1]

    def guess(self, b):
        return np.array(self._begin(b.prev[1], b.prev[0], b.low[0], b.high[0]))

    def run(self, b, state):
        out = np.full(b.n, np.nan)
        first = 0
        if state is None:
            if b.n < 2:
                return {"sar": out}, np.full(6, np.nan)
            state, first = self._begin(b.low[0], b.high[0], b.low[1], b.high[1]), 1
        long_, af, extreme, stop, low, high = state[0] > 0, *map(float, state[1:])
        lows, highs, stops = b.low.tolist(), b.high.tolist(), []
        begin, top = min(self.accel, self.maximum), self.maximum
        for t in range(first, b.n):
            low0, high0, low, high = low, high, lows[t], highs[t]
            if (low <= stop) if long_ else (high >= stop):  # stopped out: the other way from the extreme
                long_ = not long_
                stop = min(extreme, low0, low) if long_ else max(extreme, high0, high)
                stops.append(stop)
                af, extreme = begin, high if long_ else low
            else:
                stops.append(stop)
                if (high > extreme) if long_ else (low < extreme):
                    extreme, af = high if long_ else low, min(af + self.accel, top)
            stop += af * (extreme - stop)
            stop = min(stop, low0, low) if long_ else max(stop, high0, high)
        out[first:] = stops
        return {"sar": out}, np.array([float(long_), af, extreme, stop, low, high])


class HilbertCycle:
    """Ehlers' instantaneous trendline and trend mode. State: bars seen (to 64), bars in trend,
    the last values of the recursions, and the last 50 values of six series."""
    depth, warmup = 50, 63
    angles = {m: np.radians(360.0 * np.arange(m) / m) for m in range(1, 52)}
    waves = {m: (np.sin(x), np.cos(x)) for m, x in angles.items()}

    def guess(self, b):
        price = np.full(self.depth, b.prev[2])
        zero = np.zeros(self.depth)
        return np.concatenate([[64.0, 0.0], [0, 0, 0, 0, 15.0, 15.0, 0, 0, 0], price, price, zero, zero, zero, price])

    def run(self, b, state):
        H, n = self.depth, b.n
        scalars = np.zeros(11) if state is None else state[:11]
        seen, days = int(scalars[0]), scalars[1]
        i2, q2, re, im, period, sp, phase, sine, lead = scalars[2:].tolist()
        kept = np.zeros((6, H)) if state is None else state[11:].reshape(6, H)
        price, smooth, det, q1, i1, trend_sum = (np.concatenate([k, np.zeros(n)]) for k in kept)
        price[H:] = b.close
        line, mode = np.full(n, np.nan), np.full(n, np.nan)

        def transform(x, t, k):
            return (0.0962 * x[t] + 0.5769 * x[t - 2] - 0.5769 * x[t - 4] - 0.0962 * x[t - 6]) * k

        for t in range(H, H + n):
            smooth[t] = (4 * price[t] + 3 * price[t - 1] + 2 * price[t - 2] + price[t - 3]) / 10.0 if seen >= 3 else price[t]
            if seen < 6:
                trend_sum[t] = price[t]
                seen += 1
                continue
            k = 0.075 * period + 0.54
            det[t] = transform(smooth, t, k)
            q1[t] = transform(det, t, k)
            i1[t] = det[t - 3]
            ji, jq = transform(i1, t, k), transform(q1, t, k)
            was_i2, was_q2 = i2, q2
            i2 = 0.2 * (i1[t] - jq) + 0.8 * i2
            q2 = 0.2 * (q1[t] + ji) + 0.8 * q2
            re = 0.2 * (i2 * was_i2 + q2 * was_q2) + 0.8 * re
            im = 0.2 * (i2 * was_q2 - q2 * was_i2) + 0.8 * im
            p = 360.0 / math.degrees(math.atan(im / re)) if im != 0 and re != 0 else period
            p = min(p, 1.5 * period) if period else p
            period = 0.2 * min(max(p, 0.67 * period, 6.0), 50.0) + 0.8 * period
            sp = 0.33 * period + 0.67 * sp
            size = int(sp + 0.5) if sp == sp else 0
            if size > 0:
                trend_sum[t] = price[t - min(size - 1, seen):t + 1].mean()
            m = max(size, 1)
            sin, cos = self.waves[m]
            back = smooth[t - min(m - 1, seen):t + 1][::-1]
            real, imag = float(sin[:len(back)] @ back), float(cos[:len(back)] @ back)
            was_phase, was_sine, was_lead = phase, sine, lead
            if abs(imag) > 0:
                phase = math.degrees(math.atan(real / imag))
            if abs(imag) <= 0.001:
                phase += 90.0 * ((real > 0) - (real < 0))
            phase += 90.0 + (360.0 / sp if sp > 0 else 0.0) + (180.0 if imag < 0 else 0.0)
            if phase > 315.0:
                phase -= 360.0
            sine, lead = math.sin(math.radians(phase)), math.sin(math.radians(phase + 45.0))
            if seen < self.warmup:
                seen += 1
                continue
            value = (4 * trend_sum[t] + 3 * trend_sum[t - 1] + 2 * trend_sum[t - 2] + trend_sum[t - 3]) / 10.0
            line[t - H] = value
            days += 1
            crossed = (sine > lead and was_sine <= was_lead) or (sine < lead and was_sine >= was_lead)
            if crossed:
                days = 0.0
            turn = phase - was_phase
            cycle = crossed or days < 0.5 * sp or (sp > 0 and 0.67 * 360.0 / sp < turn < 1.5 * 360.0 / sp)
            if value != 0 and abs((smooth[t] - value) / value) >= 0.015:
                cycle = False
            mode[t - H] = float(not cycle)
            seen = min(seen + 1, 64)
        scalars = [float(seen), days, i2, q2, re, im, period, sp, phase, sine, lead]
        tails = [x[n:n + H] for x in (price, smooth, det, q1, i1, trend_sum)]
        return {"ht_trendline": line, "ht_trendmode": mode}, np.concatenate([scalars, *tails])


#: kind -> its kernels, all of which have a block form
KINDS = {
    "ema_engineered": [Ema(n) for n in (5, 10, 20, 50)],
    "ewm_macd": [EwmMacd()],
    "rsi14": [Rsi(14, "rsi")],
    "ema_technical": [Ema(n, True) for n in (5, 10, 20, 30)],
    "tema": [Tema()],
    "rsi_multi": [Rsi(n, f"rsi_{n}") for n in (6, 12, 24)],
    "atr": [Atr(14), Atr(21)],
    "macd_seeded": [MacdSeeded()],
    "adx": [Adx()],
    "sar": [Sar()],
    "ht": [HilbertCycle()],
}
#: bars that the first block must have at least: every seed lies in it (TEMA: 3 * 29 + 1)
LEAST_ROWS = 128


def _kernels(kinds):
    found = [k for kind in kinds for k in KINDS[kind]]
    return [k for k in found if hasattr(k, "scan")], [k for k in found if hasattr(k, "run")]


def _block(pdf: pd.DataFrame, order: str, known: dict | None) -> tuple[pd.DataFrame, Bars]:
    pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
    prev = known.get("prev") if known else None
    return pdf, Bars(pdf, None if prev is None else tuple(np.nan if prev[c] is None else prev[c] for c in ("high", "low", "close")))


def _entering(known: dict | None, stage: int, i: int):
    """A linear kernel's entering state; None where the instrument begins."""
    if not known or known.get("prev") is None:
        return None
    return np.array([np.nan if x is None else x for x in known[f"enter{stage}"][i]], dtype=float)


def compute_block(pdf: pd.DataFrame, kinds, order: str, known: dict | None = None) -> pd.DataFrame:
    """A block's rows with the columns of ``kinds``, from its entering states (None: from its start)."""
    pdf, b = _block(pdf, order, known)
    linear, machines = _kernels(kinds)
    new: dict[str, np.ndarray] = {}
    for i, kernel in enumerate(linear):
        series: dict = {}
        for stage in range(kernel.stages):
            kernel.scan(stage, b, series, _entering(known, stage, i))
        new |= kernel.outputs(b, series)
    for i, kernel in enumerate(machines):
        state = None if not known or known.get("prev") is None else np.array(known["machines"][i], dtype=float)
        new |= kernel.run(b, state)[0]
    for v in new.values():
        v[~np.isfinite(v)] = np.nan
    base = pdf.drop(columns=[c for c in new if c in pdf.columns])
    return pd.concat([base, pd.DataFrame(new, index=base.index)], axis=1)


def _summary(stage: int, kinds, order: str):
    """One row for a block: v and M of each linear kernel's stage."""
    def run(key, pdf, state):
        known = _known(state)
        _, b = _block(pdf, order, known)
        exits, matrices = [], []
        for i, kernel in enumerate(_kernels(kinds)[0]):
            if stage >= kernel.stages:
                exits.append([])
                matrices.append([])
                continue
            series: dict = {}
            for s in range(stage):
                kernel.scan(s, b, series, _entering(known, s, i))
            size = kernel.size(stage)
            starts = known["prev"] is None
            exits.append(kernel.scan(stage, b, series, None if starts else np.zeros(size)).tolist())
            matrices.append((np.zeros((size, size)) if starts else kernel.matrix(stage, b, series)).ravel().tolist())
        return pd.DataFrame([[*key, exits, matrices]])
    return run


def _compose(keys, kinds, stage):
    """Entering states of an instrument's blocks from their maps, in time order."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        sizes = [k.size(stage) if stage < k.stages else 0 for k in _kernels(kinds)[0]]
        states = [np.full(s, np.nan) for s in sizes]
        out = []
        for exits, matrices in zip(pdf["v"], pdf["m"]):
            out.append([s.tolist() for s in states])
            # 0 * NaN of an unknown state must not spoil a block that does not depend on it
            states = [np.asarray(v, float) + (np.asarray(m, float).reshape(n, n) @ s if np.any(m) else 0.0)
                      for v, m, s, n in zip(exits, matrices, states, sizes)]
        return pd.DataFrame({**{k: pdf[k].to_numpy() for k in keys}, BLOCK: pdf[BLOCK].to_numpy(), f"enter{stage}": out})
    return run


def _known(state: pd.DataFrame) -> dict:
    return state.iloc[0].to_dict() if len(state) else {"prev": None}


def _same(keys, a: DataFrame, b: DataFrame, more=()) -> DataFrame:
    """Inner join on the instrument (nulls are an instrument) and ``more`` columns."""
    right = b
    for c in (*keys, *more):
        right = right.withColumnRenamed(c, f"_r_{c}")
    on = None
    for c in (*keys, *more):
        one = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        on = one if on is None else on & one
    return a.join(right, on).drop(*[f"_r_{c}" for c in (*keys, *more)])


def blocked_panel(df: DataFrame, spec: PanelSpec, block_rows: int, bucket_seconds: int) -> tuple[DataFrame, bool]:
    """The panel with its block numbers, written once, and whether any instrument has several blocks.

    Blocks are whole time buckets: their numbers come from the buckets' row counts, so no bar is
    ranked. Bars before the first close count nothing: all seeds lie in an instrument's first block.
    """
    keys = list(spec.keys)
    panel = written(df, "panel")
    bucket = F.floor(F.unix_seconds(F.col(spec.order).cast("timestamp")) / bucket_seconds).alias("_bk")
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    counts = panel.groupBy(*keys, bucket).agg(F.count("close").alias("_n"))
    blocks = counts.select(*keys, "_bk", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / max(block_rows, LEAST_ROWS)).alias(BLOCK))
    blocks = written(blocks, "blocks")
    if not blocks.where(F.col(BLOCK) > 0).limit(1).count():
        return panel, False
    return written(_same(keys, panel.select("*", bucket), blocks, ["_bk"]).drop("_bk"), "blocked"), True


def recursive_columns(df: DataFrame, kinds, spec: PanelSpec, outputs: list[str], block_rows: int = 50_000,
                      bucket_seconds: int = 30 * 86400, tail_rows: int = 4096) -> DataFrame:
    """Add the columns of ``kinds`` (of :data:`KINDS`) to every row; see the module text.

    ``block_rows`` bounds what one task holds (rounded up to whole buckets of ``bucket_seconds``).
    """
    keys, order, kinds = list(spec.keys), spec.order, tuple(kinds)
    fields = [f for f in df.schema.fields if f.name not in outputs]
    schema = T.StructType(fields + [T.StructField(c, T.DoubleType(), True) for c in outputs])
    names = [f.name for f in schema.fields]
    rows, several = blocked_panel(df, spec, block_rows, bucket_seconds)
    if not several:
        return rows.groupBy(*keys).applyInPandas(lambda pdf: compute_block(pdf, kinds, order)[names], schema)

    slim = rows.select(*keys, BLOCK, order, *[c for c in ("high", "low", "close") if c in df.columns])
    bar = F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c) for c in ("high", "low", "close")])
    in_time = Window.partitionBy(*keys).orderBy(BLOCK)
    edges = slim.groupBy(*keys, BLOCK).agg(F.max_by(bar, order).alias("edge"))
    states = written(edges.select(*keys, BLOCK, F.lag("edge").over(in_time).alias("prev")), "edges")
    id_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name in keys) + f", {BLOCK} bigint"
    linear, machines = _kernels(kinds)

    for stage in range(max((k.stages for k in linear), default=0)):
        maps = slim.groupBy(*keys, BLOCK).cogroup(states.groupBy(*keys, BLOCK)).applyInPandas(
            _summary(stage, kinds, order), f"{id_ddl}, v array<array<double>>, m array<array<double>>")
        entering = written(maps, "maps").groupBy(*keys).applyInPandas(_compose(keys, kinds, stage), f"{id_ddl}, enter{stage} array<array<double>>")
        states = written(_same(keys, states, entering, [BLOCK]), "states")
    if machines:
        states = _replayed(slim, states, keys, order, machines, id_ddl, in_time, tail_rows)

    def final(key, pdf, state):
        return compute_block(pdf, kinds, order, _known(state))[names]
    return rows.groupBy(*keys, BLOCK).cogroup(states.groupBy(*keys, BLOCK)).applyInPandas(final, schema)


def _replayed(slim, states, keys, order, machines, id_ddl, in_time, tail_rows) -> DataFrame:
    """``states`` with the machines' entering states: speculation, then rounds of correction."""
    both = f"{id_ddl}, machines array<array<double>>, exits array<array<double>>"

    def suggested(key, pdf, state):
        """Exit states from the block's last bars alone, entered with a guess."""
        pdf, b = _block(pdf, order, _known(state))
        if len(pdf) > tail_rows:
            last = pdf.iloc[-tail_rows - 1]
            b = Bars(pdf.iloc[-tail_rows:], (last.get("high", np.nan), last.get("low", np.nan), last["close"]))
        exits = [k.run(b, None if b.prev is None else k.guess(b))[1].tolist() for k in machines]
        return pd.DataFrame([[*key, None, exits]])

    def exact(key, pdf, state):
        known = _known(state)
        _, b = _block(pdf, order, known)
        enter = None if known["prev"] is None else [np.array(s, float) for s in known["machines"]]
        exits = [k.run(b, None if enter is None else enter[i])[1].tolist() for i, k in enumerate(machines)]
        return pd.DataFrame([[*key, None if enter is None else [s.tolist() for s in enter], exits]])

    def run(fn, which):
        return slim.groupBy(*keys, BLOCK).cogroup(which.groupBy(*keys, BLOCK)).applyInPandas(fn, both)

    edges = states.select(*keys, BLOCK, "prev")
    done = written(run(suggested, edges), "suggested")
    entered = None
    while True:
        nxt = done.select(*keys, BLOCK, F.lag("exits").over(in_time).alias("machines"))
        nxt = written(_same(keys, edges, nxt, [BLOCK]), "entering")
        if entered is None:
            done = written(run(exact, nxt), "replayed")
        else:
            new = _same(keys, nxt, done.select(*keys, BLOCK, F.col("machines").alias("was"), "exits"), [BLOCK])
            moved = written(new.where(~F.col("machines").eqNullSafe(F.col("was"))).select(*keys, BLOCK, "prev", "machines"), "moved")
            if not moved.limit(1).count():
                return _same(keys, states, nxt.select(*keys, BLOCK, "machines"), [BLOCK])
            changed = _same(keys, slim, moved.select(*keys, BLOCK), [BLOCK])
            again = changed.groupBy(*keys, BLOCK).cogroup(moved.groupBy(*keys, BLOCK)).applyInPandas(exact, both)
            rest = new.where(F.col("machines").eqNullSafe(F.col("was"))).select(*keys, BLOCK, "machines", "exits")
            done = written(again.unionByName(rest), "replayed")
        entered = nxt
