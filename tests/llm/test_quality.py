import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from barlake.llm.q_quality import SQL, op3_quality_rules
from barlake.llm.quality import RULES, Risk, _tail, counts, cutoffs, quality_rules


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op3_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    got = sorted((tuple(r) for r in op3_quality_rules(spark, f"/root/testdata/{sf}").select(*cols).collect()), key=str)
    assert got == sorted(con.sql(SQL).fetchall(), key=str)
    if sf == "sf0.1":
        assert {r[8] for r in got} > {None, "symbols"}


def brute(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_of_odd_texts(spark):
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "a\na\n\n a\na", "é#🙂 <|> \x85 a\x1cb", "q w e " * 20_000, "r\r\nr\r\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("words", F.lit("clash"))
    got = {r[0]: tuple(r)[1:] for r in counts(df, "text", "i").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_binomial_tail(spark):
    cases = [(10, 0, 0.01), (1000, 3, 0.01), (5000, 30, 0.01), (200_000, 1800, 0.01), (50, 1, 0.2)]
    for n, k, p in cases:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        got = spark.sql(f"select {_tail(f'{n}L', f'{k}L', f'{p}D')}").first()[0]
        assert math.isclose(got, want, rel_tol=1e-8)


def test_few_labels_certify_nothing_and_many_do(spark):
    def rows(n):
        good = [("a", 1, 100, 500, 0, 0, 0)] * n
        return good + [("a", 0, 100, 500, 300, 0, 0)] * (n // 5)
    schema = "stratum string, quality int, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    assert cutoffs(spark.createDataFrame(rows(100), schema)).count() == 0
    got = cutoffs(spark.createDataFrame(rows(2000), schema)).collect()
    assert [(r.stratum, r.rule) for r in got] == [("a", "symbols")]


def test_the_guarantee_holds_for_noisy_labels(spark):
    # good documents whose symbol share is spread out: no cutoff may cost more than alpha / rules of them
    schema = "stratum string, quality int, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    rows = [("a", 1, 64, 320, i % 120, 0, 0) for i in range(6000)] + [("a", 0, 64, 320, 119, 0, 0)] * 3000
    got = {r.rule: r.cutoff for r in cutoffs(spark.createDataFrame(rows, schema), Risk()).collect()}
    share = sum(min(63, 32 * (i % 120) // 64) >= got.get("symbols", 99) for i in range(6000)) / 6000
    assert share <= 0.05 / len(RULES)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "w " * 60, "en"), (2, "a b " * 60, "en"), (2, "a b " * 60, "en")], "doc_id bigint, text string, lang string").withColumn("quality", F.lit(0)).withColumn("id", F.lit(0))
    labels = spark.createDataFrame([(1, None), (2, 0), (2, 1), (99, 1)], "doc_id bigint, quality int")
    got = quality_rules(docs, labels).collect()
    assert len(got) == 4 and [r.kept for r in got if r.doc_id == 1] == [False]
    assert quality_rules(docs.limit(0), labels).count() == 0
    assert quality_rules(docs, labels.limit(0)).count() == 4
