"""Registry of named queries: Spark builder + DuckDB oracle SQL + check kind.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables. ``check`` records how a query is verified: ``SQL`` and
``REC`` carry an oracle; ``ROWS`` queries (ML, streaming, iterative) are
checked by row count here and by unit tests against brute-force fixtures.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from barlake.session import ship_package

REGISTRY: dict[str, "Query"] = {}


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    check: str
    ids: str


def register(name: str, sql: str | None = None, check: str = "SQL", ids: str = ""):
    def deco(fn):
        @functools.wraps(fn)
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        REGISTRY[name] = Query(name, build, sql, check if sql or check != "SQL" else "ROWS", ids)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the families registers their queries
    from barlake.plans import (q_bars, q_clean, q_features, q_technical, q_recursive,  # noqa: F401
                               q_eval, q_select, q_relational, q_models, q_streaming)
    from barlake.plans import q_composite  # noqa: F401  (needs the families above)
    return REGISTRY
