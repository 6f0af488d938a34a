import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from barlake.llm.periodic import Periodic, _unit, periodic_runs
from barlake.llm.q_periodic import op12_periodic_runs

SF = "/root/testdata/sf0.01"


def brute(words, min_length=6, exponent=4):
    """Every maximal stretch of every period, less those that have a smaller one."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, exponent * q):
                part = words[i:j + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((i, j + q - i, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_small_alphabets_equal_brute_force():
    rng = random.Random(3)
    for params in (Periodic(), Periodic(2, 2), Periodic(9, 3), Periodic(40, 2)):
        texts = []
        for _ in range(250):
            words = [rng.choice("abc"[:rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 120))]
            for _ in range(rng.randrange(3)):  # planted periods
                p = rng.randrange(1, 30)
                base = [rng.choice("abcdefgh") for _ in range(p)]
                words += (base * 9)[:rng.randrange(1, 8 * p)] + ["x"] * rng.randrange(3)
            texts.append(words)
        found = _unit([" ".join(t).encode() for t in texts], params)
        for words, (_, runs) in zip(texts, found):
            assert [tuple(r) for r in runs.tolist()] == brute(words, params.min_length, params.exponent)


def test_long_single_word_and_long_periods():
    base = [f"w{i}" for i in range(7000)]
    texts = [" ".join(["a"] * 300_000), " ".join(base * 4 + base[:11]), " ".join(base * 3 + base[:6999])]
    one, four, less = [runs.tolist() for _, runs in _unit([t.encode() for t in texts], Periodic())]
    assert (one, four, less) == ([[0, 300_000, 1]], [[0, 28_011, 7000]], [])


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode(), b" ".join(kept(words, runs)))]
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, *sha)


def test_op12_equals_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' where length(text) < 6000").fetchall()
    got = {r[0]: tuple(r) for r in op12_periodic_runs(spark, SF).collect()}
    assert len(got) == duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    want = {i: expected(i, t) for i, t in rows}
    assert sum(w[1] > 0 for w in want.values()) > 20
    assert {i: got[i] for i in want} == want


def test_null_empty_repeats_clashes_and_empty_table(spark):
    rows = [(1, None), (1, ""), (None, "a a a a a a a"), (2, "x y " * 50_000), (2, "x y " * 50_000), (3, "\u00a0b\u2003" * 9)]  # not white space of the word rule
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted(map(tuple, periodic_runs(df).collect()), key=str)
    want = [(1, [], ""), (1, [], ""), (None, [[0, 7, 1]], "a"), (2, [[0, 100_000, 2]], "x y"), (2, [[0, 100_000, 2]], "x y"),
            (3, [], "\u00a0b\u2003" * 9)]
    assert got == sorted(want, key=str)
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Periodic(exponent=1)
