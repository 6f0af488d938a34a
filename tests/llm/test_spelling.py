import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from barlake.llm.q_spelling import op13_spelling_variants
from barlake.llm.spelling import Decomposer, Spelling, near_pairs, spelling_variants, variants

SF = "/root/testdata/sf0.01"


def deletions(word):
    return {(word[:i], word[i + 1:]) for i in range(len(word))}


def neighbours(words):
    """word -> words one edit apart: equal after one deletion on one side or, at one place, on both."""
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for a, b in deletions(w):
            holes[a, b].add(w)
            if a + b in words:
                near[w].add(a + b)
                near[a + b].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(counts, ratio=10):
    near, form = neighbours(counts), {}
    for w, found in near.items():
        if found:
            top = min(found, key=lambda x: (-counts[x], x))
            if counts[top] >= ratio * counts[w]:
                form[w] = top
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near.get(w, ())), counts[form[w]] if w in form else None))
    return sorted(out)


def table(spark, counts):
    return spark.createDataFrame(sorted(counts.items()), "word string, n bigint")


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_op13_equals_brute_force(spark):
    counts = Counter()
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    want = brute({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    got = sorted(tuple(r) for r in op13_spelling_variants(spark, SF).select(COLUMNS).collect())
    assert len(want) > 5000 and sum(w[1] is not None for w in want) > 100
    assert got == want


def test_dense_words_equal_brute_force(spark):
    rng = random.Random(11)
    for params, letters, sizes in ((Spelling(dictionary=20, max_gram=4), "abc", (7, 13)), (Spelling(dictionary=1000), "abé", (7, 11)),
                                   (Spelling(min_chars=4, dictionary=3, max_gram=5), "abcdef", (4, 12)),
                                   (Spelling(whole=9), "abc", (7, 13)), (Spelling(min_gram=3, max_gram=3), "abcd", (7, 9))):
        words = {"".join(rng.choice(letters) for _ in range(rng.randrange(*sizes))): rng.randrange(1, 10 ** rng.randrange(1, 6)) for _ in range(1500)}
        want = brute(words)
        got = sorted(tuple(r) for r in variants(table(spark, words), params).select(COLUMNS).collect())
        assert got == want


def test_every_edit_leaves_a_list_in_common():
    rng = random.Random(2)
    for _ in range(3000):
        letters = "abcd"[:rng.randrange(1, 5)]
        frequent = {"".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) for _ in range(30)}
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 15)))
        i = rng.randrange(len(word) + 1)
        other = rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1:]])
        short, long_ = sorted((word, other), key=len)
        if len(short) >= 7:
            part = Decomposer(frequent, 2, Spelling().longest(len(short)))
            own, probes = part.lists(long_)[0], part.lists(short)[len(short) < len(long_)]
            assert own & probes, (short, long_, frequent)


def test_chains_ties_and_long_words(spark):
    long_ = "x" * 3000
    words = {"abcdefgh": 100_000, "abcdefg": 5000, "abcdefi": 50, "abcdeki": 5, "abcdefx": 5000, long_: 40, long_ + "y": 3, "zzzzzzz": 1}
    got = sorted(tuple(r) for r in variants(table(spark, words)).select(COLUMNS).collect())
    assert got == brute(words)
    assert ("abcdeki", "abcdefi", "abcdefgh", 5, 1, 50) in got


def test_nulls_repeats_clashes_and_empty_table(spark):
    rows = [(1, None), (1, ""), (None, "Colours colours"), (2, "colors and COLOURS, colours"), (2, "colors and COLOURS, colours"),
            (3, "Écolours écolours rÉsumÉsx"), (4, "a" * 1_200_000 + " " + "b" * 1_200_000), (5, "a" * 1_200_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("id", F.lit(1))
    got = sorted(tuple(r) for r in spelling_variants(df, params=Spelling(min_chars=6, ratio=3)).select(COLUMNS).collect())
    assert got == [("a" * 1_200_000, None, "a" * 1_200_000, 2, 0, None), ("colors", "colours", "colours", 2, 1, 6), ("colours", None, "colours", 6, 1, None)]
    assert spelling_variants(df.limit(0)).count() == 0
    assert near_pairs(spark.createDataFrame([], "word string, n bigint")).count() == 0
    with pytest.raises(ValueError):
        Spelling(min_chars=3)
