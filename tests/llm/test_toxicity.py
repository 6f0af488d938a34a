import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from barlake.llm.q_toxicity import op2_toxicity
from barlake.llm.toxicity import Net, ToxicNet, Words, score, thresholds, toxicity, train

SF = "/root/testdata/sf0.1"
QUICK = ToxicNet(steps=40, sample=200)


def test_held_out_accuracy(spark):
    got = op2_toxicity(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    auc = np.mean([(t > c) + (t == c) / 2 for t in toxic for c in clean])
    assert auc > 0.95 and np.mean([t >= 0.5 for t in toxic]) > 0.75 and np.mean([c >= 0.5 for c in clean]) < 0.02


def test_blocks_equal_a_plain_loop():
    p = ToxicNet(dim=4, filters=3)
    rng = np.random.default_rng(0)
    net = Net(np.arange(1, 50), p)
    net.emb[1:] = rng.normal(size=net.emb[1:].shape)
    net.bias[:] = rng.normal(size=len(net.bias))
    texts = [rng.integers(0, 50, n) for n in (0, 1, 2, 3, 40, 500, 7)]
    vectors = np.concatenate([net.emb, np.zeros((1, 4), np.float32)])
    gap = np.full(2, len(vectors) - 1)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 2) - sizes - 2
    got = net.pooled(vectors, np.concatenate([x for t in texts for x in (t, gap)]), starts, sizes, block=16)
    for t, g in zip(texts, got):
        x = np.concatenate([net.emb[t], np.zeros((2, 4), np.float32)])
        want = np.zeros(9)
        for i in range(len(t)):
            y = np.concatenate([sum(x[i + j] @ k[j] for j in range(len(k))) for k in net.conv]) + net.bias
            want = np.maximum(want, y)
        assert np.allclose(g, want, atol=1e-4)


def test_thresholds_by_language(spark):
    rows = [("a", 0.7, 0)] * 30 + [("a", 0.9, 1)] * 30 + [("b", 0.2, 1)] * 30 + [("b", 0.1, 0)] * 30 + [("c", 0.9, 1)] * 3
    got = {r.lang: r.threshold for r in thresholds(spark.createDataFrame(rows, "lang string, score double, label bigint"), ToxicNet()).collect()}
    assert set(got) == {"a", "b"} and 0.7 < got["a"] <= 0.9 and 0.1 < got["b"] <= 0.2


def test_odd_tables(spark):
    docs = [(i, f"some words number {i % 7} " + ("vile " if i % 3 == 0 else ""), "en") for i in range(90)]
    docs += [(1000, None, None), (1001, "", "en"), (1002, "w " * 60_000 + "vile", "xx"), (None, "vile", "en"), (3, docs[3][1], "en")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("label", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("score", F.lit(0))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (1000, None)], "doc_id bigint, toxic int")
    got = toxicity(df, labels, params=QUICK).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(docs) and by[1000][0].score == by[1001][0].score and by[3][0].score == by[3][1].score
    assert by[1002][0].score > 0.5 > by[1][0].score and by[None][0].held_out is False
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity(df.limit(0), labels, params=QUICK).count() == 0
    assert {r.predicted for r in toxicity(df, labels.limit(0), params=QUICK).collect()} == {0}


def test_training_counts_hashes_in_little_memory():
    """The driver trains: no Python object for each distinct hash."""
    texts = [np.arange(i * 3000, (i + 1) * 3000, dtype=np.uint32).reshape(-1, 3) for i in range(200)] + [np.arange(30, dtype=np.uint32).reshape(-1, 3)] * 2
    tracemalloc.start()
    net = train(texts, np.arange(202) % 2, ToxicNet(steps=0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert net.ids.tolist() == list(range(1, 30)) and peak < 40e6
