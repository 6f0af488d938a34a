"""op12: runs of every document's words, a tenth of the documents continued periodically.
SQL cannot express the search; tests/llm/test_periodic.py holds it against brute force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlake.llm.periodic import Periodic, periodic_runs
from barlake.llm.text import read_table

PARAMS = Periodic(min_length=6, exponent=4)
WORD = r"[^\x20\x09-\x0D]+"


def continued(text: Column, doc_id: Column) -> Column:
    """The text, or for a tenth of the ids its words with a periodic continuation from word a on."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.get(words, i.cast("int"))), " ")

    # a let: the list of words is evaluated once for the expressions above
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), 0)
    return F.when((h % 10 == 0) & text.isNotNull(), planted).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from ``runs`` and ``collapsed``."""
    top = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-r[1]).alias("a"), r[0].alias("b"), r[2].alias("c")))), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.array_join(r.cast("array<string>"), ","), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), top["b"].alias("start"), (-top["a"]).alias("length"),
        top["c"].alias("period"), F.floor(-1000 * top["a"] / top["c"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", continued(F.col("text"), F.col("doc_id")).alias("text"))
    return digest(periodic_runs(docs, params=PARAMS))


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
