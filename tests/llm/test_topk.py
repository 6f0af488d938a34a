import math
import random

import duckdb
from pyspark.sql import functions as F

from barlake.llm.q_topk import ORACLES, op11_topk_search
from barlake.llm.topk import TopK, top_k

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def brute(rows, is_query, k=20):
    """Every query row against all rows of other ids; rows as (id, vector)."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if is_query(i):
            found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i and len(c) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, params=TopK(), kind="double"):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(3)
    df = df.withColumn("score", F.lit("clash")).withColumn("id", F.lit(0)).withColumn("row", F.lit(1))
    return sorted(map(tuple, top_k(df, F.col("vec_id") % 20 == 0, params=params).collect()))


def test_op11_equals_sql_and_brute_force(spark):
    got = sorted(map(tuple, op11_topk_search(spark, SF).collect()))
    duckdb.sql(f"create or replace view embeddings as select * from '{SF}/embeddings.parquet'")
    assert got == sorted(duckdb.sql(ORACLES["op11_topk_search"]).select("query_id, rank, vec_id, score").fetchall())
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    assert got == brute(rows, lambda i: i % 20 == 0)


def test_ties_slices_and_wide_ranges(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 1.0]), 1.0, 0.5]) for i in range(400)]  # few values, many ties
    rows += [(400 + i, [rng.uniform(-1, 1) * 10 ** rng.randrange(6) for _ in range(3)]) for i in range(300)]
    want = brute(rows, lambda i: i % 20 == 0)
    assert run(spark, rows) == want
    assert run(spark, rows, TopK(slice_bytes=3000, block_rows=7, bins=2, sortable=1)) == want
    short = brute(rows, lambda i: i % 20 == 0, 3)
    assert run(spark, rows, TopK(k=3, bins=100)) == short


def test_nulls_repeats_dimensions_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [None, 1.0]), (60, [NAN, 1.0]), (80, [INF, 1.0]), (None, [1.0, 1.0]),
            (100, [1.0]), (120, []), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [9.0, -1.0]), (3, [1.0]), (4, []), (5, []),
            (140, [1e30, 1.0]), (160, [0.5, 1.0]), (160, [0.5, 1.0])]
    tame = [r for r in rows if r[0] != 140]
    assert run(spark, tame) == brute(tame, lambda i: i % 20 == 0)
    top = (1 << 62) - 1  # a product beyond 62 bits counts as the end of the range
    assert [(j, s) for q, _, j, s in run(spark, rows) if q == 140] == [
        (j, top) for j in (0, 1, 1, 2, 160, 160)]
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert top_k(df, F.col("vec_id") % 20 == 0).count() == 0
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(0, [1.0])]) == []
