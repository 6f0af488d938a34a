"""Per-instrument window specs and null-safe column helpers.

All time-series operators are written against a :class:`PanelSpec`, so the
same expressions run over the natural partitioning (one window partition per
instrument) or over halo-padded time blocks of a long series
(:mod:`barlake.plans.blocked`). Every operator that shares a spec shares one
Exchange + Sort in the physical plan.

Null contract: ``rolling(n)`` in the pandas sense is null until ``n`` non-null
values are inside the frame (:meth:`PanelSpec.full`); divisions are
``try_divide`` (null on zero); nothing emits NaN or infinity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

KEY = "stock_code"
TIME = "date"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """a / b, null when b is zero or null (ANSI-safe)."""
    return F.try_divide(col(a), col(b))


def div_or_zero(a, b) -> Column:
    """a / b with a zero result on a zero divisor (indicator convention)."""
    b = col(b)
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(col(a), b))


@dataclass(frozen=True)
class PanelSpec:
    keys: tuple = (KEY,)
    order: str = TIME

    # -- frames ---------------------------------------------------------
    def w(self):
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def trailing(self, n: int):
        return self.w().rowsBetween(-(n - 1), 0)

    def prior(self, first: int, last: int):
        """Frame of rows ``first``..``last`` bars back (first >= last >= 1)."""
        return self.w().rowsBetween(-first, -last)

    def cumulative(self):
        return self.w().rowsBetween(Window.unboundedPreceding, 0)

    def ahead(self):
        """Current row to the end. Spark re-evaluates such frames per row
        (quadratic): prefer :meth:`reverse_cumulative` for next-value lookups."""
        return self.w().rowsBetween(0, Window.unboundedFollowing)

    def reverse_cumulative(self):
        """Cumulative frame in descending time order: ``last(..., ignorenulls)``
        over it is the next non-null value, evaluated incrementally (linear)."""
        return (Window.partitionBy(*self.keys).orderBy(F.col(self.order).desc())
                .rowsBetween(Window.unboundedPreceding, 0))

    def unordered(self):
        return Window.partitionBy(*self.keys)

    # -- shifts -----------------------------------------------------------
    def lag(self, c, k: int = 1) -> Column:
        return F.lag(col(c), k).over(self.w())

    def lead(self, c, k: int = 1) -> Column:
        return F.lead(col(c), k).over(self.w())

    def diff(self, c, k: int = 1) -> Column:
        return col(c) - self.lag(c, k)

    def pct_change(self, c, k: int = 1) -> Column:
        return div(c, self.lag(c, k)) - 1

    # -- rolling aggregates (pandas rolling(n) null semantics) -------------
    def count(self, c, n: int) -> Column:
        return F.count(col(c)).over(self.trailing(n))

    def full(self, n: int, c, expr: Column) -> Column:
        """``expr`` where the last n bars of ``c`` are all non-null, else null."""
        return F.when(self.count(c, n) == n, expr)

    def mean(self, c, n: int) -> Column:
        return self.full(n, c, F.avg(col(c)).over(self.trailing(n)))

    def sum(self, c, n: int) -> Column:
        return self.full(n, c, F.sum(col(c)).over(self.trailing(n)))

    def std(self, c, n: int) -> Column:
        """Sample standard deviation (pandas rolling std)."""
        return self.full(n, c, F.stddev_samp(col(c)).over(self.trailing(n)))

    def std_pop(self, c, n: int) -> Column:
        return self.full(n, c, F.stddev_pop(col(c)).over(self.trailing(n)))

    def max(self, c, n: int) -> Column:
        return self.full(n, c, F.max(col(c)).over(self.trailing(n)))

    def min(self, c, n: int) -> Column:
        return self.full(n, c, F.min(col(c)).over(self.trailing(n)))

    def corr(self, a, b, n: int) -> Column:
        """Rolling Pearson; null on a constant window (Spark's corr raises)."""
        fr = self.trailing(n)
        pair = F.when(col(a).isNotNull() & col(b).isNotNull(), F.lit(1))
        cov = F.covar_pop(col(a), col(b)).over(fr)
        sx = F.stddev_pop(F.when(pair.isNotNull(), col(a))).over(fr)
        sy = F.stddev_pop(F.when(pair.isNotNull(), col(b))).over(fr)
        r = F.try_divide(cov, sx * sy)
        return F.when(F.count(pair).over(fr) == n, r)

    def wma(self, c, n: int) -> Column:
        """Linearly weighted mean, newest bar weight n (TA WMA)."""
        terms = [self.lag(c, k) * float(n - k) if k else col(c) * float(n) for k in range(n)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total / float(n * (n + 1) / 2)

    # -- row position inside the instrument --------------------------------
    def row_number(self) -> Column:
        return F.row_number().over(self.w())


DEFAULT = PanelSpec()


def safe_corr(a, b) -> Column:
    """Aggregate Pearson correlation over complete pairs, null for a constant column."""
    x = F.when(col(b).isNotNull(), col(a))
    y = F.when(col(a).isNotNull(), col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def add_rolling(df, spec: PanelSpec, stats: dict) -> "DataFrame":
    """Add full-window rolling statistics, each computed exactly once.

    ``stats`` maps output name → (aggregate, column, n) with aggregate one of
    avg, sum, stddev_samp, stddev_pop, max, min. Spark does not merge
    semantically equal window expressions, so a statistic referenced by several
    outputs would be recomputed per reference; here every distinct
    (aggregate, column, n) and every (column, n) non-null count is one window
    column, and the pandas ``rolling(n)`` null mask is applied in a projection.
    """
    counts, raws = {}, {}
    for _, (fn, c, n) in stats.items():
        counts.setdefault((c, n), f"__cnt_{c}_{n}")
        raws.setdefault((fn, c, n), f"__{fn}_{c}_{n}")
    step = {name: F.count(F.col(c)).over(spec.trailing(n)) for (c, n), name in counts.items()}
    step.update({name: getattr(F, fn)(F.col(c)).over(spec.trailing(n)) for (fn, c, n), name in raws.items()})
    out = df.withColumns(step)
    final = {name: F.when(F.col(counts[(c, n)]) == n, F.col(raws[(fn, c, n)]))
             for name, (fn, c, n) in stats.items()}
    return out.withColumns(final).drop(*counts.values(), *raws.values())
