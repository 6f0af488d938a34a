import random

import duckdb
from pyspark.sql import functions as F

from barlake.llm.q_url_filter import SQL, op7_url_filter
from barlake.llm.url_filter import bloom_filter, judge_urls, may_hold

SF = "/root/testdata/sf0.01"


def test_op7_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.sql(SQL).fetchall()
    got = [tuple(r) for r in op7_url_filter(spark, SF).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got) == sorted(want) and {r[4] for r in got} == {"allow", "block"}


def fits(host, path, rules):
    found = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found)[1:] if found else (None, "allow")


def test_odd_urls_and_a_long_list(spark):
    rng = random.Random(2)
    rules = [("net", "/", "block"), ("a.net", "/x", "allow"), ("org", "", "block"), ("b.org", "/p", "block")]
    rules += [(f"h{i}.com", f"/{'d' * (i % 7)}", rng.choice(["allow", "block"])) for i in range(3000)]
    urls = ["HTTP://A.Net/x?y", "http://a.net", "a.net/x", None, "", "x://", "://net/", "http://u.a.net/xx#f", "http://borg/p", "http://q.org?x",
            "http://b.org/p/", "http://b.org:80/p", "http://net/\nz", "http://net/a", "http://net/a", "http://" + "s." * 2000 + "net/" + "p" * 50_000]
    urls += [f"http://{rng.choice(['', 'w.'])}h{rng.randrange(4000)}.com/{'d' * rng.randrange(8)}" for _ in range(2000)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("words", F.lit(1))
    listed = spark.createDataFrame(rules + [(None, "/", "block"), ("h1.com", None, "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(df, listed).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        assert got[i] == (fits(host, path, rules) if host else (None, "allow")), u
    assert {r.verdict for r in judge_urls(df, listed.limit(0)).collect()} == {"allow"}
    assert judge_urls(df.limit(0), listed).count() == 0


def test_filter_holds_every_key_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = bloom_filter(keys).scalar()
    probe = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") < 20_000).alias("there")).withColumn("words", words)
    n = {r.there: r.n for r in probe.where(may_hold("words", "key")).groupBy("there").agg(F.count("*").alias("n")).collect()}
    assert n[True] == 20_000 and n.get(False, 0) < 400
