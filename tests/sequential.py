"""Brute force of the recursive indicators: one bar after another, one instrument at a time."""
import math

import numpy as np
import pandas as pd

INPUTS = ("open", "high", "low", "close", "volume")
EPS = 1e-8


def _nan(n: int) -> np.ndarray:
    return np.full(n, np.nan)


def _is_zero(v: float) -> bool:
    return -EPS < v < EPS


# -- linear recursions ----------------------------------------------------------

def ema_seeded(x: np.ndarray, n: int, start: int | None = None, seed_at: int | None = None) -> np.ndarray:
    """EMA seeded by the simple mean of the n values ending at ``seed_at``.

    ``start`` defaults to the first non-NaN index; the seed sits at
    ``start + n - 1`` unless ``seed_at`` moves it later (MACD alignment).
    """
    out = _nan(len(x))
    if start is None:
        valid = np.flatnonzero(~np.isnan(x))
        if len(valid) == 0:
            return out
        start = int(valid[0])
    at = start + n - 1 if seed_at is None else seed_at
    if at >= len(x) or at - n + 1 < 0:
        return out
    a = 2.0 / (n + 1)
    e = float(np.mean(x[at - n + 1:at + 1]))
    out[at] = e
    for t in range(at + 1, len(x)):
        e = a * x[t] + (1 - a) * e
        out[t] = e
    return out


def ewm_adjusted(x: np.ndarray, span: int) -> np.ndarray:
    """pandas ``ewm(span).mean()`` (adjust=True): weighted by (1-α)^age, from row 0."""
    a = 2.0 / (span + 1)
    out = _nan(len(x))
    num = den = 0.0
    for t in range(len(x)):
        num *= (1 - a)
        den *= (1 - a)
        if not math.isnan(x[t]):
            num += x[t]
            den += 1.0
        out[t] = num / den if den > 0 else np.nan
    return out


def rsi_wilder(c: np.ndarray, n: int) -> np.ndarray:
    """Wilder RSI: seeds are means of the first n gains/losses; 0 when flat."""
    out = _nan(len(c))
    if len(c) <= n:
        return out
    d = np.diff(c)
    g = np.where(d > 0, d, 0.0)
    lo = np.where(d < 0, -d, 0.0)
    ag, al = float(np.mean(g[:n])), float(np.mean(lo[:n]))
    s = ag + al
    out[n] = 0.0 if _is_zero(s) else 100.0 * ag / s
    for t in range(n + 1, len(c)):
        ag = (ag * (n - 1) + g[t - 1]) / n
        al = (al * (n - 1) + lo[t - 1]) / n
        s = ag + al
        out[t] = 0.0 if _is_zero(s) else 100.0 * ag / s
    return out


def true_range(h: np.ndarray, lo: np.ndarray, c: np.ndarray) -> np.ndarray:
    tr = _nan(len(c))
    if len(c) > 1:
        pc = c[:-1]
        tr[1:] = np.maximum.reduce([h[1:] - lo[1:], np.abs(h[1:] - pc), np.abs(lo[1:] - pc)])
    return tr


def atr(h: np.ndarray, lo: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Wilder ATR: first value = mean of the first n true ranges (bars 1..n)."""
    tr = true_range(h, lo, c)
    out = _nan(len(c))
    if len(c) <= n:
        return out
    a = float(np.mean(tr[1:n + 1]))
    out[n] = a
    for t in range(n + 1, len(c)):
        a = (a * (n - 1) + tr[t]) / n
        out[t] = a
    return out


def macd_seeded(c: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9):
    """TA MACD: both EMAs seeded so they start at bar slow-1; outputs from
    bar (slow-1)+(signal-1), all three aligned."""
    size = len(c)
    line = _nan(size)
    sig = _nan(size)
    first = slow - 1
    if size <= first:
        return line, sig, _nan(size)
    es = ema_seeded(c, slow, start=0)
    ef = ema_seeded(c, fast, seed_at=first)
    raw = es.copy()
    raw[first:] = ef[first:] - es[first:]
    raw[:first] = np.nan
    s = ema_seeded(raw, signal, start=first)
    begin = first + signal - 1
    line[begin:] = raw[begin:]
    sig[begin:] = s[begin:]
    return line, sig, line - sig


def tema(c: np.ndarray, n: int = 30) -> np.ndarray:
    e1 = ema_seeded(c, n)
    e2 = ema_seeded(e1, n)
    e3 = ema_seeded(e2, n)
    return 3 * e1 - 3 * e2 + e3


# -- nonlinear state machines ------------------------------------------------------

def adx(h: np.ndarray, lo: np.ndarray, c: np.ndarray, n: int = 14) -> np.ndarray:
    """Wilder ADX; first value at bar 2n-1."""
    size = len(c)
    out = _nan(size)
    if size < 2 * n:
        return out
    ph, pl, pc = h[0], lo[0], c[0]
    pdm = mdm = tr = 0.0

    def step(t, pdm, mdm, tr, ph, pl, pc, smooth):
        dp = h[t] - ph
        dm = pl - lo[t]
        ph, pl = h[t], lo[t]
        if smooth:
            mdm -= mdm / n
            pdm -= pdm / n
        if dm > 0 and dp < dm:
            mdm += dm
        elif dp > 0 and dp > dm:
            pdm += dp
        r = max(ph - pl, abs(ph - pc), abs(pl - pc))
        tr = tr - tr / n + r if smooth else tr + r
        return pdm, mdm, tr, ph, pl, c[t]

    t = 0
    for _ in range(n - 1):
        t += 1
        pdm, mdm, tr, ph, pl, pc = step(t, pdm, mdm, tr, ph, pl, pc, False)
    sum_dx = 0.0
    for _ in range(n):
        t += 1
        pdm, mdm, tr, ph, pl, pc = step(t, pdm, mdm, tr, ph, pl, pc, True)
        if not _is_zero(tr):
            mdi, pdi = 100 * mdm / tr, 100 * pdm / tr
            s = mdi + pdi
            if not _is_zero(s):
                sum_dx += 100 * abs(mdi - pdi) / s
    val = sum_dx / n
    out[t] = val
    while t < size - 1:
        t += 1
        pdm, mdm, tr, ph, pl, pc = step(t, pdm, mdm, tr, ph, pl, pc, True)
        if not _is_zero(tr):
            mdi, pdi = 100 * mdm / tr, 100 * pdm / tr
            s = mdi + pdi
            if not _is_zero(s):
                val = (val * (n - 1) + 100 * abs(mdi - pdi) / s) / n
        out[t] = val
    return out


def sar(h: np.ndarray, lo: np.ndarray, accel: float = 0.02, maximum: float = 0.2) -> np.ndarray:
    """Wilder parabolic stop-and-reverse; first value at bar 1.

    The initial direction is short when the second bar shows a dominant
    downward move (low drop larger than high rise), else long.
    """
    size = len(h)
    out = _nan(size)
    if size < 2:
        return out
    af = min(accel, maximum)
    down = lo[0] - lo[1]
    up = h[1] - h[0]
    is_long = not (down > 0 and up < down)
    if is_long:
        ep, s = h[1], lo[0]
    else:
        ep, s = lo[1], h[0]
    new_lo, new_hi = lo[1], h[1]
    for t in range(1, size):
        prev_lo, prev_hi = new_lo, new_hi
        new_lo, new_hi = lo[t], h[t]
        if is_long:
            if new_lo <= s:
                is_long = False
                s = max(ep, prev_hi, new_hi)
                out[t] = s
                af = min(accel, maximum)
                ep = new_lo
                s = max(s + af * (ep - s), prev_hi, new_hi)
            else:
                out[t] = s
                if new_hi > ep:
                    ep = new_hi
                    af = min(af + accel, maximum)
                s = min(s + af * (ep - s), prev_lo, new_lo)
        else:
            if new_hi >= s:
                is_long = True
                s = min(ep, prev_lo, new_lo)
                out[t] = s
                af = min(accel, maximum)
                ep = new_hi
                s = min(s + af * (ep - s), prev_lo, new_lo)
            else:
                out[t] = s
                if new_lo < ep:
                    ep = new_lo
                    af = min(af + accel, maximum)
                s = max(s + af * (ep - s), prev_hi, new_hi)
    return out


def hilbert_trend(price: np.ndarray, warmup: int = 63):
    """Ehlers' instantaneous trendline and trend/cycle mode (published form).

    Returns (trendline, trendmode); both null for the first ``warmup`` bars.
    """
    size = len(price)
    trend_line = _nan(size)
    mode = _nan(size)
    if size <= warmup:
        return trend_line, mode
    a, b = 0.0962, 0.5769
    smooth = np.zeros(size)
    det = np.zeros(size)
    q1 = np.zeros(size)
    i1 = np.zeros(size)
    i2 = np.zeros(size)
    q2 = np.zeros(size)
    re = np.zeros(size)
    im = np.zeros(size)
    period = np.zeros(size)
    sp = np.zeros(size)
    itrend = np.zeros(size)
    phase = np.zeros(size)
    sine = np.zeros(size)
    lead = np.zeros(size)
    days_in_trend = 0

    def hil(x, t, k):
        return (a * x[t] + b * x[t - 2] - b * x[t - 4] - a * x[t - 6]) * k

    for t in range(size):
        if t >= 3:
            smooth[t] = (4 * price[t] + 3 * price[t - 1] + 2 * price[t - 2] + price[t - 3]) / 10.0
        else:
            smooth[t] = price[t]
        if t < 6:
            period[t] = period[t - 1] if t else 0.0
            sp[t] = sp[t - 1] if t else 0.0
            itrend[t] = price[t]
            continue
        k = 0.075 * period[t - 1] + 0.54
        det[t] = hil(smooth, t, k)
        q1[t] = hil(det, t, k)
        i1[t] = det[t - 3]
        ji = hil(i1, t, k)
        jq = hil(q1, t, k)
        i2[t] = 0.2 * (i1[t] - jq) + 0.8 * i2[t - 1]
        q2[t] = 0.2 * (q1[t] + ji) + 0.8 * q2[t - 1]
        re[t] = 0.2 * (i2[t] * i2[t - 1] + q2[t] * q2[t - 1]) + 0.8 * re[t - 1]
        im[t] = 0.2 * (i2[t] * q2[t - 1] - q2[t] * i2[t - 1]) + 0.8 * im[t - 1]
        p = period[t - 1]
        if im[t] != 0 and re[t] != 0:
            p = 360.0 / math.degrees(math.atan(im[t] / re[t]))
        p = min(p, 1.5 * period[t - 1]) if period[t - 1] else p
        p = max(p, 0.67 * period[t - 1])
        p = min(max(p, 6.0), 50.0)
        period[t] = 0.2 * p + 0.8 * period[t - 1]
        sp[t] = 0.33 * period[t] + 0.67 * sp[t - 1]
        dc = int(sp[t] + 0.5)
        if dc > 0:
            lo = max(0, t - dc + 1)
            itrend[t] = float(np.mean(price[lo:t + 1]))
        # dominant-cycle phase of the smoothed price
        real = imag = 0.0
        for j in range(max(dc, 1)):
            if t - j < 0:
                break
            ang = math.radians(360.0 * j / max(dc, 1))
            real += math.sin(ang) * smooth[t - j]
            imag += math.cos(ang) * smooth[t - j]
        ph = phase[t - 1]
        if abs(imag) > 0:
            ph = math.degrees(math.atan(real / imag))
        if abs(imag) <= 0.001:
            ph = ph + 90.0 * (1 if real > 0 else -1 if real < 0 else 0)
        ph += 90.0
        if sp[t] > 0:
            ph += 360.0 / sp[t]
        if imag < 0:
            ph += 180.0
        if ph > 315.0:
            ph -= 360.0
        phase[t] = ph
        sine[t] = math.sin(math.radians(ph))
        lead[t] = math.sin(math.radians(ph + 45.0))
        if t < warmup:
            continue
        tl = (4 * itrend[t] + 3 * itrend[t - 1] + 2 * itrend[t - 2] + itrend[t - 3]) / 10.0
        trend_line[t] = tl
        trend = 1
        days_in_trend += 1
        crossed = ((sine[t] > lead[t] and sine[t - 1] <= lead[t - 1])
                   or (sine[t] < lead[t] and sine[t - 1] >= lead[t - 1]))
        if crossed:
            days_in_trend = 0
            trend = 0
        if days_in_trend < 0.5 * sp[t]:
            trend = 0
        dphase = phase[t] - phase[t - 1]
        if sp[t] > 0 and 0.67 * 360.0 / sp[t] < dphase < 1.5 * 360.0 / sp[t]:
            trend = 0
        if tl != 0 and abs((smooth[t] - tl) / tl) >= 0.015:
            trend = 1
        mode[t] = float(trend)
    return trend_line, mode


def _k_ema_engineered(a):
    return {f"ema_{n}": ema_seeded(a["close"], n) for n in (5, 10, 20, 50)}


def _k_ewm_macd(a):
    m = ewm_adjusted(a["close"], 12) - ewm_adjusted(a["close"], 26)
    s = ewm_adjusted(m, 9)
    return {"macd": m, "macd_signal": s, "macd_histogram": m - s}


def _k_rsi14(a):
    return {"rsi": rsi_wilder(a["close"], 14)}


def _k_ema_technical(a):
    out = {}
    for n in (5, 10, 20, 30):
        e = ema_seeded(a["close"], n)
        out[f"ema_{n}"] = e
        with np.errstate(divide="ignore", invalid="ignore"):
            out[f"price_ema_{n}_ratio"] = np.where(e != 0, a["close"] / e, np.nan)
    return out


def _k_tema(a):
    return {"tema": tema(a["close"], 30)}


def _k_rsi_multi(a):
    return {f"rsi_{n}": rsi_wilder(a["close"], n) for n in (6, 12, 24)}


def _k_atr(a):
    return {f"atr_{n}": atr(a["high"], a["low"], a["close"], n) for n in (14, 21)}


def _k_macd_seeded(a):
    m, s, h = macd_seeded(a["close"])
    return {"macd": m, "macd_signal": s, "macd_histogram": h}


def _k_adx(a):
    return {"adx": adx(a["high"], a["low"], a["close"], 14)}


def _k_sar(a):
    return {"sar": sar(a["high"], a["low"])}


def _k_ht(a):
    tl, mode = hilbert_trend(a["close"])
    return {"ht_trendline": tl, "ht_trendmode": mode}


KERNELS = {
    "ema_engineered": (_k_ema_engineered, [f"ema_{n}" for n in (5, 10, 20, 50)]),
    "ewm_macd": (_k_ewm_macd, ["macd", "macd_signal", "macd_histogram"]),
    "rsi14": (_k_rsi14, ["rsi"]),
    "ema_technical": (_k_ema_technical, [c for n in (5, 10, 20, 30)
                                         for c in (f"ema_{n}", f"price_ema_{n}_ratio")]),
    "tema": (_k_tema, ["tema"]),
    "rsi_multi": (_k_rsi_multi, [f"rsi_{n}" for n in (6, 12, 24)]),
    "atr": (_k_atr, ["atr_14", "atr_21"]),
    "macd_seeded": (_k_macd_seeded, ["macd", "macd_signal", "macd_histogram"]),
    "adx": (_k_adx, ["adx"]),
    "sar": (_k_sar, ["sar"]),
    "ht": (_k_ht, ["ht_trendline", "ht_trendmode"]),
}

def compute(pdf: pd.DataFrame, kinds, order: str, kernels: dict | None = None) -> pd.DataFrame:
    """Pure-pandas core (also used by tests as the brute-force reference).

    New columns are assembled once (one concat), not inserted one by one."""
    kernels = kernels or KERNELS
    pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
    arrays = {c: pdf[c].to_numpy(dtype="float64", na_value=np.nan)
              for c in INPUTS if c in pdf.columns}
    new = {}
    for k in kinds:
        for name, values in kernels[k][0](arrays).items():
            v = np.asarray(values, dtype="float64")
            v[~np.isfinite(v)] = np.nan
            new[name] = v
    base = pdf.drop(columns=[c for c in new if c in pdf.columns])
    return pd.concat([base, pd.DataFrame(new, index=base.index)], axis=1)
