import hashlib

import duckdb
from pyspark.sql import functions as F

from barlake.llm.chat_tree import format_trees, format_turn, read_conversations, read_turns
from barlake.llm.q_chat import SQL, op4_chat_format

SF = "/root/testdata/sf0.01"


def test_op4_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(tuple(r) for r in op4_chat_format(spark, SF).select(*cols).collect()) == sorted(con.sql(SQL).fetchall())


def test_template_is_reversible():
    odd = ["", "\\", "</turn>\n", "<turn user>", "\\<", "a\\\\>b", "\n", r"\### Assistant: </turn> ok"]
    for role in odd:
        for text in odd:
            formatted, a, b = format_turn(role, text)
            assert [(r, t, x, y) for r, t, x, y in read_turns(formatted * 2)][0] == (role, text, a, b)


def trees(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("path", F.lit("clash")).withColumn("n", F.lit(1))
    segments, leaves = format_trees(df)
    return segments, {r.conv_id: r for r in read_conversations(segments, leaves).collect()}


def test_shared_turns_are_emitted_once_and_attended(spark):
    rows = []
    for c in range(40):  # a hot first turn, a shared second one for half, own turns after
        rows += [(c, 0, "user", "common first"), (c, 1, "assistant", f"second {c % 2}"), (c, 2, "user", f"own {c // 2}")]
    rows += [(100, 0, "user", "common first")] + [(101, i, "user", "alone") for i in range(3)] + [(102, i, "user", "alone") for i in range(3)]
    segments, got = trees(spark, rows)
    seg = segments.collect()
    texts = [t for s in seg for _, t, _, _ in read_turns(s.text)]
    assert texts.count("common first") == 1 and texts.count("second 0") == 1 and texts.count("alone") == 3 and len(texts) == 1 + 2 + 40 + 3
    for tree in {bytes(s.tree) for s in seg}:
        own = sorted((s for s in seg if bytes(s.tree) == tree), key=lambda s: s.start)
        end = 0
        for s in own:  # gapless depth-first order; ancestors come before and give the position
            assert s.start == end and s.position == sum(x.end - x.start for x in s.attends)
            end += s.chars
            up = [o for o in own if (o.start, o.start + o.chars) in {(x.start, x.end) for x in s.attends}]
            assert all(bytes(s.path).startswith(bytes(o.path)) and o.path != s.path for o in up) and len(up) == len(s.attends)
    assert got[7].n_turns == 3 and got[100].n_turns == 1 and got[101].turns_sha256 == got[102].turns_sha256


def test_odd_rows(spark):
    long = "x" * 3_000_000
    rows = [(1, 0, None, None), (2, 0, "assistant", ""), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (None, 0, "user", "q"),
            (4, None, "user", "first"), (4, 0, "assistant", long)] + [(5, i, "user", "same" * 300) for i in range(3000)]
    _, got = trees(spark, rows)
    sha = lambda *p: hashlib.sha256("".join(p).encode()).hexdigest()
    assert len(got) == 6 and got[1].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0
    assert got[3].n_turns == 3 and got[3].loss_sha256 == sha("bb") and got[None].n_turns == 1
    assert got[4].turns_sha256 == sha("user\nfirst\nassistant\n", long, "\n") and got[4].loss_chars == len(long)
    assert got[5].n_turns == 3000 and got[5].turns_sha256 == sha(*["user\n" + "same" * 300 + "\n"] * 3000)
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert read_conversations(*format_trees(empty)).count() == 0
