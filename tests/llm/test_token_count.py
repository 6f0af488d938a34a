import random

import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barlake.llm.q_token_count import op6_token_counts
from barlake.llm.token_count import Merges, UnitCounts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)]


def test_op6_equals_the_library(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, library([t or "" for _, t in rows]))]
    assert sorted(map(tuple, op6_token_counts(spark, SF).collect())) == want


def test_odd_texts_equal_the_library():
    rng = random.Random(1)
    odd = ["", "  ", "a  b\n\n c \t\td", "aaaaaaa aaaaaaaaaaaa", "<|endoftext|>x <|endoftext|>  <|endoftext|> y ",
           "I'm we'll 'sss ''d don't.'s", "x\x85y z  w \x1c\x1d a", "日本語 テキスト🙂🙂", "½²Ⅷ ١٢٣ x²,y", "a" * 3000,
           "".join(rng.choice("abcdefghij") for _ in range(5000)), "\r\n\r\n a b", "naïve, café.", "--==++ ()()), x!?"]
    odd += ["".join(rng.choice(" \n\tab,.'é½1<|>-") for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert UnitCounts(Merges(PATH), limit=500).count(odd) == library(odd)


def test_null_repeats_clashes_and_empty_table(spark):
    rows = [(1, None), (1, None), (None, "two words"), (2, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted(map(tuple, token_counts(df, PATH).collect()), key=str)
    want = library(["two words", "x" * 200_000])
    assert got == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 9, want[0], False), (2, 200_000, want[1], want[1] > 1024)], key=str)
    assert token_counts(df.limit(0), PATH).count() == 0
