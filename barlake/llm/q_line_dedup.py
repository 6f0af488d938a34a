"""op1: all documents without passages that an earlier document, or an earlier place, has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlake.llm.line_dedup import LineDedup, dedup_lines
from barlake.llm.text import read_table

PARAMS = LineDedup()


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, params=PARAMS).select("doc_id", "n_lines", "n_removed", "text")


def sql(table: str) -> str:
    """DuckDB text of the operator over a table of doc_id and text, windows by their full lines."""
    return rf"""
with d as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '{PARAMS.line}') as ls from {table}),
w as (select doc_id, k, list_transform(ls[k:k + {PARAMS.window - 1}], lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as g
      from d, unnest(range(1, len(ls) - {PARAMS.window - 2})) as t(k)),
r as (select doc_id, k from (select doc_id, k, row_number() over (partition by g order by doc_id, k) as n from w) where n > 1),
c as (select distinct doc_id, k + j as k from r, unnest(range(0, {PARAMS.window})) as t(j)),
s as (select doc_id, k, k - row_number() over (partition by doc_id order by k) as run from c),
z as (select doc_id, min(k) as a, max(k) as b from s group by doc_id, run),
big as (select doc_id, a, b from z join d using (doc_id)
        where len(regexp_extract_all(list_aggregate(ls[a:b], 'string_agg', ''), '[^\x20\x09-\x0D]+')) >= {PARAMS.min_words}),
gone as (select doc_id, list(k) as ks from big, unnest(range(a, b + 1)) as t(k) group by doc_id)
select doc_id, len(ls)::bigint as n_lines, coalesce(len(ks), 0)::bigint as n_removed,
       case when ks is null then text
            else coalesce(list_aggregate(list_filter(ls, lambda x, i: not list_contains(ks, i)), 'string_agg', ''), '') end as text
from d left join gone using (doc_id)
"""


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": sql("documents")}
