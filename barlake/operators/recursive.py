"""Recursive indicators of a panel: indicators that depend on their own previous value.

EMA family, Wilder smoothing, adjusted EWM, the SAR state machine and the Hilbert cycle cannot be
written as bounded window aggregates. :mod:`barlake.operators.scans` has them in block form, so
an instrument of any length is many tasks; kernels that users register see an
instrument's bars as one group.

Fixed values (TA conventions, must match for equal results):
EMA smoothing alpha = 2 / (n + 1), seeded with the simple mean of the first n
values; Wilder smoothing alpha = 1 / n seeded with the mean of the first n
changes; MACD periods 12 / 26 / 9; SAR acceleration 0.02, maximum 0.2;
zero test tolerance 1e-8.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barlake.functions.windows import DEFAULT, PanelSpec
from barlake.operators import scans

#: outputs of each kind
OUTPUTS = {
    "ema_engineered": [f"ema_{n}" for n in (5, 10, 20, 50)],
    "ewm_macd": ["macd", "macd_signal", "macd_histogram"],
    "rsi14": ["rsi"],
    "ema_technical": [c for n in (5, 10, 20, 30) for c in (f"ema_{n}", f"price_ema_{n}_ratio")],
    "tema": ["tema"],
    "rsi_multi": [f"rsi_{n}" for n in (6, 12, 24)],
    "atr": ["atr_14", "atr_21"],
    "macd_seeded": ["macd", "macd_signal", "macd_histogram"],
    "adx": ["adx"],
    "sar": ["sar"],
    "ht": ["ht_trendline", "ht_trendmode"],
}
#: kernels that users registered: kind -> (function, outputs)
KERNELS: dict = {}

BASIC = ("ewm_macd",)
ENGINEERED = ("ema_engineered", "ewm_macd", "rsi14")
TECHNICAL = ("ema_technical", "tema", "rsi_multi", "atr", "macd_seeded", "adx", "sar")
CYCLES = ("ht",)
INPUTS = ("open", "high", "low", "close", "volume")


def output_columns(kinds) -> list[str]:
    cols: list[str] = []
    for k in kinds:
        cols += [c for c in (OUTPUTS[k] if k in OUTPUTS else KERNELS[k][1]) if c not in cols]
    return cols


def _grouped(df: DataFrame, kinds, spec: PanelSpec) -> DataFrame:
    """Registered kernels: one instrument's bars in time order, in one group."""
    new = output_columns(kinds)
    fields = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType(fields + [T.StructField(c, T.DoubleType(), True) for c in new])
    order, kernels = spec.order, {k: KERNELS[k][0] for k in kinds}  # in the closure, so that they reach the workers

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        arrays = {c: pdf[c].to_numpy(dtype="float64", na_value=np.nan) for c in INPUTS if c in pdf.columns}
        found: dict = {}
        for fn in kernels.values():
            found |= {name: np.where(np.isfinite(v), v, np.nan) for name, v in fn(arrays).items()}
        return pdf.drop(columns=[c for c in new if c in pdf.columns]).assign(**found)[[f.name for f in schema.fields]]

    return df.groupBy(*spec.keys).applyInPandas(run, schema)


def apply_recursive(df: DataFrame, kinds, spec: PanelSpec = DEFAULT, block_rows: int = 50_000,
                    bucket_seconds: int = 30 * 86400) -> DataFrame:
    """Add the recursive columns of ``kinds``; later kinds win where two have a column in common.

    Instruments of more than about ``block_rows`` bars are cut into blocks (see :mod:`scans`)."""
    built_in = [k for k in kinds if k not in KERNELS]
    if built_in:
        df = scans.recursive_columns(df, built_in, spec, output_columns(built_in), block_rows, bucket_seconds)
    own = [k for k in kinds if k in KERNELS]
    return _grouped(df, own, spec) if own else df


def register_kernel(name: str, fn, outputs: list[str]) -> None:
    """Add a recursive indicator: ``fn(arrays: dict[str, ndarray]) -> dict[str, ndarray]``
    over one instrument's bars in time order, producing ``outputs``. It runs in a grouped map
    by instrument, so an instrument's bars must fit one task."""
    KERNELS[name] = (fn, list(outputs))
