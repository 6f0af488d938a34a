import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from barlake.llm.q_decontaminate import op5_decontamination
from barlake.llm.q_line_dedup import sql as line_sql
from barlake.session import written
from test_minhash import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_documents_keep_their_columns(stages):
    for one in stages[1:5]:
        assert one.dtypes == stages[0].dtypes
        assert one.where("n_chars <> length(text)").count() == stages[0].where("n_chars <> length(text)").count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = stages[1].join(labels, "doc_id").groupBy("toxic").count().collect()
    all_ = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    kept = {r.toxic: r["count"] for r in left}
    assert kept.get(1, 0) < 0.25 * all_[1] and kept[0] >= 0.98 * all_[0]


def test_line_stage_equals_sql(stages):
    con = duckdb.connect()
    con.register("before", stages[1].select("doc_id", "text").toArrow())
    want = {r[0]: r[3] for r in con.sql(line_sql("before")).fetchall()}
    assert {i: r.text for i, r in rows(stages[2]).items()} == want


def test_near_stage_equals_brute_force(stages):
    before = [(i, r.text) for i, r in rows(stages[2]).items()]
    assert set(rows(stages[3])) == {i for i, (_, c) in brute(sorted(before), width=5).items() if c == i}


def test_benchmark_passages_are_gone(spark, stages, tmp_path):
    stages[3].write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    hit = {r.doc_id: r for r in op5_decontamination(spark, str(tmp_path)).collect()}
    before, after = rows(stages[3]), rows(stages[4])
    for i, r in hit.items():
        if not r.contaminated:
            assert after[i] == before[i]
        elif 2 * r.n_hit > r.n_words:
            assert i not in after
        else:
            assert len(after[i].text) < len(before[i].text)


def test_every_remaining_document_is_packed(stages):
    pieces = stages[5]
    assert pieces.select("doc_id").distinct().count() == stages[4].count()
    assert pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).where("n <> t").count() == 0


def test_odd_documents_pass_through(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows_ = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", None, 5), (3, "x " * 50_000, "xx", "s", 100_000), (3, "x " * 50_000, "xx", "s", 100_000)]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for given in (rows_, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in cp.STAGES:
            docs = written(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        assert (docs.count() > 0) == bool(given)
