"""Catalog: composite checks that run a whole family in one plan.

Imported last by the catalog, so every per-family oracle already exists."""

from __future__ import annotations

from barlake.plans.catalog import REGISTRY, register
from barlake.plans.common import clean_panel, finalize

KEYS = ["stock_code", "date"]


# -- T29 as one plan: every window family + one grouped map, checked column-for-column
_LIB_PARTS = ["sma_ratio", "wma", "momentum_roc", "willr", "cci", "bollinger_multi", "true_range", "aroon",
              "volume_sma", "mfi", "obv_vwap", "price_transforms", "candles",
              "ema", "tema", "rsi_wilder", "atr", "macd_seeded", "adx", "sar"]


def _library_sql() -> str:
    parts = [f"({REGISTRY[n].sql}) t{i}" for i, n in enumerate(_LIB_PARTS)]
    return "SELECT * FROM " + " JOIN ".join(
        [parts[0]] + [f"{p} USING (stock_code, date)" for p in parts[1:]])


@register("indicator_library", _library_sql(), check="REC", ids="T29 (all groups but the Hilbert cycle pair, one plan)")
def q_indicator_library(spark, d):
    from barlake.operators import technical as T
    out = T.all_indicators(clean_panel(spark, d), cycles=False)
    names = [c for c in T.indicator_names() if not c.startswith("ht_")]
    return finalize(out.select(*KEYS, *names), overrides={"obv": 4, "vwap": 4})
