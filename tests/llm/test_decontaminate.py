import hashlib
import re

import duckdb
from pyspark.sql import functions as F

import barlake.llm.decontaminate as module
from barlake.llm.decontaminate import Decontamination, decontaminate, scan
from barlake.llm.q_decontaminate import SQL, op5_decontamination

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(10, len(v))
            for g in ({tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n else ()):
                for k in range(len(w) - n + 1):
                    if tuple(w[k:k + n]) == g:
                        hit |= set(range(k, k + n))
                        found.add(i)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_op5_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = sorted(map(tuple, op5_decontamination(spark, SF).collect()))
    assert got == sorted(con.sql(SQL).fetchall())


def test_odd_rows_against_brute_force(spark):
    ten = "a b c d e f g h i j"
    items = [(1, ten + " k"), (2, "Short, item!"), (3, None), (4, ""), (5, "..."), (6, ten), (7, "ünï Éx")]
    docs = [(1, None), (2, ""), (3, "x " + ten.upper() + " k l"), (4, "short-item short item"), (5, "ünï ÉX ünï Éx"), (6, "short"),
            (6, "short"), (None, ten), (7, "z " * 50_000 + ten), (8, ten + " " + ten)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("items", F.lit(1)).withColumn("item_id", F.lit(2))
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for p in (Decontamination(), Decontamination(max_words=4)):
        got = [(r.row.doc_id, r.n_words, sum(s.b - s.a for s in r.spans), len(r["items"]),
                hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest(), bool(r.spans)) for r in scan(d, b, params=p).collect()]
        assert sorted(got, key=str) == brute(docs, items)
    assert scan(d.limit(0), b).count() == 0
    assert all(not r.spans for r in scan(d, b.limit(0)).collect())


def test_spans_leave_the_text(spark):
    ten = "a b c d e f g h i j"
    docs = [(1, "Before, it. " + ten + "! After it " + "w " * 30), (2, ten), (3, "clean  text\n"), (4, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert decontaminate(d.withColumn("row", F.lit(1)), d.limit(0).withColumnRenamed("doc_id", "item_id")).columns == ["doc_id", "text", "row"]
    b = spark.createDataFrame([(1, ten)], "item_id bigint, text string")
    got = dict(map(tuple, decontaminate(d, b).collect()))
    assert got == {1: "Before, it. ! After it " + "w " * 30, 3: "clean  text\n", 4: None}


def test_a_slice_is_scanned_before_the_next_is_read(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "nine eight seven six")], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, f"one two three four item{i}") for i in range(8)], "item_id bigint, text string")
    events, kind = [], type(docs)
    collect, writes = kind.collect, module.written
    monkeypatch.setattr(kind, "collect", lambda self: events.append("read") or collect(self))
    monkeypatch.setattr(module, "written", lambda df, name: events.append("scan") or writes(df, name))
    scan(docs, items, params=Decontamination(max_words=4))
    steps = events[1:]  # the first reads the benchmark's size
    assert len(steps) > 4 and steps == ["read", "scan"] * (len(steps) // 2) + ["read"]
