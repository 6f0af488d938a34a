"""op11: the 20 nearest rows, by integer inner product, of every 20th row of `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlake.llm.text import read_table
from barlake.llm.topk import TopK, top_k

PARAMS = TopK(k=20, scale=64.0)


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, params=PARAMS)


QUERIES = {"op11_topk_search": op11_topk_search}
ORACLES = {"op11_topk_search": f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= {PARAMS.k}
"""}
