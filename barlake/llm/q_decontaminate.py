"""op5: documents against the benchmark's ten-word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlake.llm.decontaminate import Decontamination, scan
from barlake.llm.text import read_table

PARAMS = Decontamination(window=10)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, read_table(spark, sf_dir, "benchmark"), params=PARAMS)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null),
n as (select item_id, ws, least(10, len(ws)) as width from i where len(ws) > 0),
grams as (
  select distinct item_id, width, list_aggregate(ws[k:k + width - 1], 'string_agg', ' ') as g
  from n, unnest(range(1, len(ws) - width + 2)) as t(k)),
pos as (
  select doc_id, k, width, list_aggregate(ws[k:k + width - 1], 'string_agg', ' ') as g
  from w, (select distinct width from grams), unnest(range(1, len(ws) - width + 2)) as t(k) where len(ws) >= width),
hit as (select doc_id, k, pos.width, item_id from pos join grams using (width, g)),
covered as (select doc_id, count(distinct k + j) as n_hit from hit, unnest(range(0, width)) as t(j) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select doc_id, coalesce(len(ws), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join covered using (doc_id) left join named using (doc_id)
"""

QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES = {"op5_decontamination": SQL}
