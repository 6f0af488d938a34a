"""Shared pieces of the query catalog: output normalisation and SQL fragments.

Every catalog query returns doubles rounded to a fixed number of decimals
and integer columns as BIGINT, in both Spark and the DuckDB oracle, so the
order-insensitive value hash compares like with like (summation order differs
between engines in the last bits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.sources.panels import load_panel
from barlake.operators.clean import clean_bars

DIGITS = 6


# Rounding boundary just below one half: prices and counts are short decimals,
# so their exact quotients often sit on a decimal tie (x.xxxxxx5) that two
# engines reach from opposite sides; a boundary off the decimal grid avoids it.
OFFSET = 0.499755859375


def round_half_up(c, digits: int = DIGITS):
    """``floor(x·10^d + offset) / 10^d``: plain IEEE arithmetic, so Spark and
    the oracle round a bit-identical input to a bit-identical output (Spark's
    ``round`` works on the decimal string and differs on exact binary ties)."""
    scale = float(10 ** digits)
    return F.floor(c * scale + OFFSET) / scale


def finalize(df: DataFrame, digits: int = DIGITS, overrides: dict | None = None) -> DataFrame:
    """Round every double column, widen integer columns to BIGINT."""
    overrides = overrides or {}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_half_up(c.cast("double"), overrides.get(f.name, digits)).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(c.cast("bigint").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def clean_panel(spark, sf_dir: str, panel: str = "events") -> DataFrame:
    return clean_bars(load_panel(spark, sf_dir, panel), dedupe=False)


# -- DuckDB side ----------------------------------------------------------------------

BAR_SQL = {
    "events": """
SELECT event_type AS stock_code,
       date_trunc('hour', ts) AS date,
       arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume,
       sum(value) AS amount
FROM events WHERE value IS NOT NULL AND ts IS NOT NULL
GROUP BY 1, 2""",
    "suppliers": """
SELECT CAST(l_suppkey AS VARCHAR) AS stock_code,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
       arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey,
               l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey,
               l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)) AS close,
       CAST(sum(l_quantity) AS DOUBLE) AS volume, sum(l_extendedprice) AS amount
FROM lineitem WHERE l_quantity > 0 AND l_shipdate IS NOT NULL
GROUP BY 1, 2""",
    "brands": """
SELECT p_brand AS stock_code,
       CAST(l_shipdate AS DATE) - CAST(isodow(l_shipdate) - 1 AS INTEGER) AS date,
       arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey,
               l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey,
               l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)) AS close,
       CAST(sum(l_quantity) AS DOUBLE) AS volume, sum(l_extendedprice) AS amount
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_quantity > 0 AND l_shipdate IS NOT NULL
GROUP BY 1, 2""",
    "nations": """
SELECT CAST(c_nationkey AS VARCHAR) AS stock_code, CAST(o_orderdate AS DATE) AS date,
       arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high,
       min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close,
       CAST(count(*) AS DOUBLE) AS volume, sum(o_totalprice) AS amount
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL
GROUP BY 1, 2""",
}

VALID_SQL = ("open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low AND "
             "high >= open AND high >= close AND low <= open AND low <= close AND volume >= 0")


def with_bars(panel: str = "events", clean: bool = True) -> str:
    """CTE prefix defining ``bars`` (and ``clean`` when requested)."""
    sql = f"WITH bars AS ({BAR_SQL[panel]})"
    if clean:
        sql += f",\nclean AS (SELECT * FROM bars WHERE {VALID_SQL})"
    return sql


def rnd(cols, digits: int = DIGITS) -> str:
    """SQL projection list rounding each column like :func:`finalize`."""
    return ", ".join(f"{rnd_expr(c, digits)} AS {c}" for c in cols)


def rnd_expr(expr: str, digits: int = DIGITS) -> str:
    return f"floor(({expr}) * 1e{digits} + CAST(0.499755859375 AS DOUBLE)) / 1e{digits}"


W = "PARTITION BY stock_code ORDER BY date"


def frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full_sql(n: int, c: str, expr: str) -> str:
    """SQL twin of PanelSpec.full."""
    return f"CASE WHEN count({c}) OVER {frame(n)} = {n} THEN {expr} END"


def mean_sql(c: str, n: int) -> str:
    return full_sql(n, c, f"avg({c}) OVER {frame(n)}")


def lag_sql(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) OVER ({W})"


def div_sql(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"
