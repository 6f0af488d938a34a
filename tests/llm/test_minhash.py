import random

import duckdb
from pyspark.sql import functions as F

from barlake.llm.minhash import MinHash, near_duplicates
from barlake.llm.q_minhash import PARAMS, op8_minhash_near_dedup

SF = "/root/testdata/sf0.01"


def brute(rows, width=4):
    """rows: (id, text); -> id -> (n_shingles, component) by comparing all pairs that share a shingle."""
    sets, inv = {}, {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        for s in sets[i]:
            inv.setdefault(s, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, s in sets.items():
        for j in {j for x in s for j in inv[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_op8_equals_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_minhash_near_dedup(spark, SF).collect()}
    assert got == want


def test_odd_rows(spark, docs_schema):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE\ttwo"), (5, long), (6, long + " tail"), (None, long), (7, " \n "),
            (8, "a b c d e f"), (8, "a b c d e f"), (9, "x")]
    df = (spark.createDataFrame(rows, "doc_id bigint, text string")
          .withColumn("digest", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("key", F.lit(None)))
    got = sorted(near_duplicates(df, params=PARAMS).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    comp = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows)
    assert comp[1] == (0, 1, True) and comp[2] == (0, 2, True) and comp[7] == (0, 7, True)
    assert comp[3] == (1, 3, True) and comp[4] == (1, 3, False)
    assert comp[6] == (29_998, 5, False) and comp[None][1:] == (5, True) and comp[8] == (3, 8, True)


def test_empty_table(spark, docs_schema):
    assert near_duplicates(spark.createDataFrame([], docs_schema)).count() == 0


def test_a_group_over_several_blocks_and_a_chain(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):  # a drifting chain: neighbours are similar, far ends are not
        base = base[:]
        base[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(base)))
    p = MinHash(shingle=4, block=16)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), params=p).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_one_id_with_several_texts_is_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (1, a), (9, b), (7, ""), (7, c), (3, c + " more"), (8, None), (8, ""), (9, b + " end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, params=PARAMS).collect()}
    assert got == {(1, 1, True), (5, 1, False), (9, 1, False), (3, 3, True), (7, 3, False), (8, 8, True)}
