"""barlake: market-panel analytics expressed as Spark DataFrame jobs.

A *bar panel* is a long DataFrame keyed by ``(stock_code, date)`` with OHLCV
columns. Every operator here takes and returns DataFrames; Catalyst plans the
work, per-instrument windows share one Exchange + Sort, and the few genuinely
sequential recursions run as Arrow-batched grouped maps.
"""

__version__ = "0.1.0"
