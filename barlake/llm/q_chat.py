"""op4: all conversations as prefix trees, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlake.llm.chat_tree import format_trees, read_conversations
from barlake.llm.text import read_table

# The conversation that the query adds.
ADDED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id bigint, turn bigint, role string, text string")
    return read_conversations(*format_trees(given.unionByName(added)))


# a turn `<turn ROLE>TEXT</turn>\n` has 15 characters besides role and text, and one more for each escaped one
SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(15 + length(regexp_replace(role || text, '([\\<>])', '\\\1', 'g')))::bigint as formatted_chars
from t group by conv_id
"""

QUERIES = {"op4_chat_format": op4_chat_format}
ORACLES = {"op4_chat_format": SQL}
