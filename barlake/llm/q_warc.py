"""op9: all pages written as WARC records in ZIP packages and read back by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlake.llm.text import read_table
from barlake.llm.warc import package_folder, read_packages, write_packages


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = package_folder(spark)
    manifest = write_packages(read_table(spark, sf_dir, "pages"), folder, least_bytes=0)
    return read_packages(manifest, folder).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


# base32 of the digest: its 40 hex digits are 8 groups of 5, and each group is 4 letters
SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, html, sha1(html) as x, min(page_id) over (partition by html) as first from p),
d as (select *, list_transform(range(0, 8), lambda g: ('0x' || substr(x, (g * 5 + 1)::bigint, 5))::bigint) as gs from h)
select page_id, strlen(html)::bigint as payload_bytes,
       list_aggregate(list_transform(gs, lambda v: list_aggregate(list_transform([15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::bigint + 1, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
       case when first = page_id then 'response' else 'revisit' end as record_type,
       case when first = page_id then null else first end as refers_to
from d
"""

QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": SQL}
