import duckdb
import pytest
from pyspark.sql import functions as F

from barlake.llm.line_dedup import LineDedup, covered_texts, dedup_lines
from barlake.llm.q_line_dedup import ORACLES, op1_line_dedup

SF = "/root/testdata/sf0.01"


def test_op1_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(ORACLES["op1_line_dedup"]).fetchall()
    got = [tuple(r) for r in op1_line_dedup(spark, SF).select("doc_id", "n_lines", "n_removed", "text").collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in got) > 1000


PASSAGE = "The first sentence of the passage. " + " ".join(f"word{i}" for i in range(30)) + ". A short one. " + " ".join(f"tail{i}" for i in range(20)) + "."


def test_a_passage_stays_once_wherever_it_stands(spark):
    rows = [(3, "Some own words here. " + PASSAGE + " And the end."), (1, PASSAGE + "\nNext line."), (2, "glued before " + PASSAGE.replace(". ", ".\n"))]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == rows[1][1] and got[3] == "Some own words here. And the end."
    assert got[2].startswith("glued before The first") and "word3 " not in got[2] and "tail3" not in got[2]


UNBROKEN = [
    "the old harbour town had always lived from the boats that came in at dawn with herring and cod and went out again before "
    "noon while the women on the quay mended nets for their brothers and told each other what the weather would do to the "
    "fishing grounds north of the islands once the autumn storms began again in earnest",
    "старый портовый город всегда жил за счёт лодок которые приходили на рассвете с рыбой и уходили снова до полудня пока "
    "женщины на набережной чинили сети для своих братьев и рассказывали друг другу что погода сделает с местами лова к "
    "северу от островов когда осенние штормы снова начнутся всерьёз и рыбаки вытащат свои лодки на берег до самой весны",
]


@pytest.mark.parametrize("passage", UNBROKEN)
def test_a_passage_without_a_sentence_end_is_found_at_every_phase(spark, passage):
    """Pasted after 0 to 9 words of a sentence, and with no sentence end in it: the counter alone cuts each copy elsewhere."""
    words = passage.split()
    assert len(words) > 50 and not any(c in passage for c in ".!?,;:")
    rows = [(i, "An opening. " + "".join(f"Q{i}{'x' * j}k " for j in range(i)) + passage + f" tail{i}k and more. End of {i}.") for i in range(10)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 10):
        assert " ".join(words[20:30]) not in got[i] and len(set(words) - set(got[i].split())) > len(set(words)) / 2
        assert got[i].startswith("An opening. ") and got[i].endswith(f"End of {i}.")


def test_odd_rows(spark):
    junk = "x. " * 40_000
    rows = [(1, None), (2, ""), (3, " \n "), (4, junk), (5, "one line"), (6, "a. b. c."), (7, "a. b. c."), (8, PASSAGE), (8, PASSAGE), (None, PASSAGE), (None, None), (9, "y" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", F.lit("i")).withColumn("n_lines", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("w", F.lit(None))
    got = dedup_lines(df).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "id", "row", "w", "n_lines", "n_removed"]
    text = {}
    for r in got:
        text.setdefault(r.doc_id, []).append(r.text)
    assert text[1] == [None] and text[2] == [""] and text[3] == [" \n "] and text[4] == ["x. "]
    assert text[6] == text[7] == ["a. b. c."] and text[8] == [PASSAGE] * 2 and set(text[None]) == {PASSAGE, None} and len(text[9][0]) == 100_000
    assert dedup_lines(df.limit(0)).count() == 0
    assert dedup_lines(spark.createDataFrame([(1, "a. b. c."), (2, "a. b. c.")], "doc_id bigint, text string"), params=LineDedup(min_words=3)).where("n_removed = 3 and text = ''").count() == 1


def test_the_filter_keeps_every_listed_hash(spark):
    from barlake.llm.line_dedup import maybe_among
    rows = spark.range(60_000).select(F.xxhash64("id").alias("w"), "id")
    listed = rows.where("id < 20000").select("w")
    kept = {r.id for r in maybe_among(rows, listed).collect()}
    assert kept >= set(range(20_000)) and len(kept) < 20_000 + 400
    assert maybe_among(rows, listed.limit(0)).count() == 0


def test_own_repeats_are_found_once(spark):
    """With the marks of single rows the last pass need not hash their windows again."""
    three = "a one. b two. c three. "
    rows = [(1, three + "d. " + three), (2, "x. y. z. v."), (3, three), (3, three + three), (None, three + three)]
    marks = {r.id: r for r in covered_texts(spark.createDataFrame(rows, "id bigint, text string"), LineDedup()).collect()}
    assert set(marks) == {1, 2, 3} and list(marks[1].own) == [4] and marks[1].at is None and marks[1].rows == 1
    assert list(marks[2].own) == [] and marks[2].at is None and marks[3].rows == 2 and sorted(marks[3].at)[0] == 0


def test_rows_of_one_id_lose_only_what_each_repeats(spark):
    twice = PASSAGE + " In between. " + PASSAGE
    rows = [(5, twice), (5, PASSAGE), (None, twice), (7, twice.replace("word", "other").replace("tail", "more"))]
    got = sorted((str(r.doc_id), r.n_removed > 0, len(r.text)) for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert [g[:2] for g in got] == [("5", False), ("5", True), ("7", True), ("None", True)] and got[0][2] == len(PASSAGE)
