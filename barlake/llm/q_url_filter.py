"""op7: every page's URL against the listed hosts and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlake.llm.text import read_table
from barlake.llm.url_filter import judge_urls

# The rules of the query, host, path and verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " as t(host, path, verdict)")
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


SQL = """
with rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
c as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
f as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as verdict
      from c join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from c left join f using (page_id)
"""

QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES = {"op7_url_filter": SQL}
