"""Benchmark: headline barlake workloads on the driver tables.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is planned and fully executed into Spark's ``noop`` sink (every
row computed, nothing collected); times are wall seconds per query after one
warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from barlake.operators import clean, engineered, evaluate, models, ranking, recursive, relational  # noqa: E402
from barlake.operators import portfolio, splits, technical  # noqa: E402
from barlake.plans.common import clean_panel  # noqa: E402
from barlake.plans.q_eval import long_predictions, wide_predictions  # noqa: E402
from barlake.session import get_session  # noqa: E402
from barlake.sources.panels import load_panel, table  # noqa: E402


def q_bars_events(spark, d):
    return load_panel(spark, d, "events")


def q_bars_suppliers(spark, d):
    return load_panel(spark, d, "suppliers")


def q_flagship(spark, d):
    from barlake.plans.q_bars import flagship
    return flagship(spark, d)


def q_window_indicators(spark, d):
    return technical.window_indicators(clean_panel(spark, d, "suppliers"))


def q_recursive_indicators(spark, d):
    return recursive.apply_recursive(clean_panel(spark, d, "suppliers"), recursive.TECHNICAL)


def q_all_indicators(spark, d):
    return technical.all_indicators(clean_panel(spark, d, "suppliers"), cycles=False)


def q_engineered(spark, d):
    return engineered.engineer_features(clean_panel(spark, d, "nations"))[0]


def q_clean_fill(spark, d):
    from barlake.sources.panels import gap_grid
    g = gap_grid(clean.clean_bars(load_panel(spark, d, "nations")), "1 day")
    return clean.interpolate(g, ["close", "volume"])


def q_evaluation(spark, d):
    lp = long_predictions(spark, d, "suppliers")
    return evaluate.regression_metrics(lp).join(evaluate.portfolio_metrics(lp), "model")


def q_information_ratio(spark, d):
    return evaluate.information_ratio(long_predictions(spark, d, "suppliers"))


def q_long_short(spark, d):
    return portfolio.long_short(wide_predictions(spark, d, "suppliers"), "momentum", "y", 10)


def q_asof_join(spark, d):
    ev = table(spark, d, "events").where(F.col("value").isNotNull())
    return relational.asof_previous_bar(ev.select("event_id", "event_type", "ts", "value"), load_panel(spark, d))


def q_time_split(spark, d):
    return splits.time_split(clean_panel(spark, d, "suppliers").select("stock_code", "date"))


def q_ridge_train_score(spark, d):
    bars = clean_panel(spark, d, "suppliers")
    f = engineered.price_features(bars)
    f = splits.next_return_label(f)
    feats = ["return_1d", "return_5d", "high_low_ratio_5d", "amplitude", "price_position_10d"]
    m = models.fit("ridge", f, feats, "target_return_1d")
    return models.predict(m, f, keep=["stock_code", "date"])


def q_stream_bars(spark, d):
    """Structured Streaming: drain all ticks through the watermarked bar query."""
    import uuid
    from barlake.session import scratch_path
    from barlake.streaming import bars as ZB
    ck = scratch_path(spark, f"bench/stream/{uuid.uuid4().hex}")
    q = (ZB.stream_bars(ZB.tick_stream(spark, d, glob="events.parquet")).writeStream.format("noop")
         .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return None


def q_top_bottom(spark, d):
    latest = ranking.latest_rows(wide_predictions(spark, d, "suppliers"))
    return ranking.top_bottom(latest, 10, score="momentum")


QUERIES = {
    "bars_events": q_bars_events,
    "bars_suppliers": q_bars_suppliers,
    "flagship": q_flagship,
    "window_indicators": q_window_indicators,
    "recursive_indicators": q_recursive_indicators,
    "all_indicators": q_all_indicators,
    "engineered_features": q_engineered,
    "gap_fill_interpolate": q_clean_fill,
    "evaluation": q_evaluation,
    "information_ratio": q_information_ratio,
    "long_short": q_long_short,
    "asof_join": q_asof_join,
    "time_split": q_time_split,
    "ridge_train_score": q_ridge_train_score,
    "top_bottom": q_top_bottom,
    "stream_bars": q_stream_bars,
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app_name="barlake-bench")
    # warm-up: JVM, Python workers, Arrow
    load_panel(spark, sf_dir, "events").write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in QUERIES.items():
        t0 = time.perf_counter()
        df = fn(spark, sf_dir)
        if df is not None:  # streaming workloads run to completion themselves
            df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "spark": spark.version,
                      "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}))


if __name__ == "__main__":
    main()
