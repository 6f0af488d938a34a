r"""Chat formatting as prefix trees: turns that conversations share are emitted once.

Template: a turn is ``<turn ROLE>TEXT</turn>`` and a line break. Inside roles and texts every
``\``, ``<`` and ``>`` gets a backslash in front, so no text can look like a mark, and reading
is exact. Tokens are code points; no mark is split between segments, so a tokenizer can be
applied segment by segment.

A conversation's turns form a path of chained digests. Consecutive turns passed by the same
number of conversations belong to one segment (a radix tree), so a path is no longer than its
branchings. Within a tree (equal first segments) segments stand in depth-first order, which is
the order of their paths: paths are range-sorted, so a tree of any size is spread over many
tasks, and the offsets are running sums whose carries are one row for each task. A segment has

* ``start``: offset of its first token in the tree's sequence,
* ``position``: position id of that token, counting along its own path only,
* ``attends``: intervals of the sequence its tokens may attend to besides their own segment,
* ``loss``: intervals of its text that are assistant text.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from barlake.llm.text import tune
from barlake.session import written

LONGEST = 1 << 20  # characters after which a segment without branching is cut
ESCAPED = re.compile(r"\\([\\<>])")
SPECIAL = re.compile(r"([\\<>])")
TURN = re.compile(r"<turn ((?:[^\\<>]|\\[\\<>])*)>((?:[^\\<>]|\\[\\<>])*+)</turn>\n")
LOSS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def escape(text: str) -> str:
    return SPECIAL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """Formatted turn, and where its text begins and ends."""
    head, body = f"<turn {escape(role)}>", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def read_turns(formatted: str):
    """(role, text, start, end) of each formatted turn; refuses anything else."""
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted turn")
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows, schema: pa.Schema, most: int = 1 << 20):
    """Record batches of rows, each of about `most` characters of text at most."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


NEW = object()


def _chained(id_type: pa.DataType):
    """Rows sorted by conversation and turn -> the digest of all turns up to each."""
    schema = pa.schema([("conv", id_type), ("i", pa.int64()), ("digest", pa.binary()), ("role", pa.string()), ("text", pa.string())])

    def rows(batches):
        conv, i, digest = NEW, 0, b""
        for c, role, text in _rows(batches):
            if c != conv or conv is NEW:
                conv, i, digest = c, 0, b""
            r = role.encode()
            digest = hashlib.blake2b(digest + struct.pack("<Q", len(r)) + r + text.encode(), digest_size=16).digest()
            yield c, i, digest, role, text
            i += 1
    return lambda batches: _batches(rows(batches), schema)


def _segmented(id_type: pa.DataType):
    """Rows of a conversation with the number of conversations through each -> its segments."""
    schema = pa.schema([("conv", id_type), ("path", pa.binary()), ("position", pa.int64()), ("text", pa.string()), ("loss", LOSS), ("leaf", pa.bool_())])

    def rows(batches):
        conv, through, open_ = NEW, None, None
        for c, digest, role, text, n in _rows(batches):
            if c != conv or conv is NEW:
                if open_:
                    yield conv, *_closed(open_), True
                conv, through, open_ = c, None, None
            if open_ is None or n != through or open_["chars"] > LONGEST:
                path, position = b"", 0
                if open_:
                    yield conv, *_closed(open_), False
                    path, position = open_["path"], open_["position"] + open_["chars"]
                open_ = {"path": path + digest, "position": position, "parts": [], "loss": [], "chars": 0}
            through = n
            turn, a, b = format_turn(role, text)
            if role == "assistant":
                open_["loss"].append({"a": open_["chars"] + a, "b": open_["chars"] + b})
            open_["parts"].append(turn)
            open_["chars"] += len(turn)
        if open_:
            yield conv, *_closed(open_), True
    return lambda batches: _batches(rows(batches), schema)


def _closed(one: dict):
    return one["path"], one["position"], "".join(one["parts"]), one["loss"]


def _placed():
    """Range-sorted segments -> offset in the tree among this task's segments, and the task."""
    schema = pa.schema([("path", pa.binary()), ("position", pa.int64()), ("text", pa.string()), ("loss", LOSS),
                        ("chars", pa.int64()), ("task", pa.int64()), ("within", pa.int64())])

    def rows(batches):
        task, tree, at = TaskContext.get().partitionId(), None, 0
        for path, position, text, loss in _rows(batches):
            if path[:16] != tree:
                tree, at = path[:16], 0
            yield path, position, text, loss, len(text), task, at
            at += len(text)
    return lambda batches: _batches(rows(batches), schema)


def format_trees(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(segments, conversations) of a table of turns.

    ``segments``: tree, path, start, chars, position, text, loss, attends. ``conversations``:
    ``conv_col`` and the path of its last segment. Defined cases: turns are ordered by turn
    number (null first), then role and text, so repeated rows are turns of their own; null
    roles and texts are empty; rows with a null conversation form one; other columns are
    ignored; an empty table gives no rows. A conversation of any length passes through a task
    turn by turn.
    """
    spark = turns.sparkSession
    tune(spark)
    named = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = named.schema["conv"].dataType
    id_type, id_sql = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string(), kind.simpleString()
    if id_sql not in ("bigint", "int", "string"):
        raise TypeError("conversation ids are integers or strings")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chained = written(named.repartition(tasks, "conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
                      .mapInArrow(_chained(id_type), f"conv {id_sql}, i bigint, digest binary, role string, text string"), "chat-turns")
    through = chained.groupBy("digest").agg(F.count("*").alias("n"))
    counted = chained.join(through, "digest").repartition(tasks, "conv").sortWithinPartitions("conv", "i")
    loss = "array<struct<a: bigint, b: bigint>>"
    parts = written(counted.select("conv", "digest", "role", "text", "n").mapInArrow(
        _segmented(id_type), f"conv {id_sql}, path binary, position bigint, text string, loss {loss}, leaf boolean"), "chat-parts")

    once = parts.groupBy("path").agg(F.any_value("position").alias("position"), F.any_value("text").alias("text"), F.any_value("loss").alias("loss"))
    placed = written(once.repartitionByRange(tasks, "path").sortWithinPartitions("path").mapInArrow(
        _placed(), f"path binary, position bigint, text string, loss {loss}, chars bigint, task bigint, within bigint"), "chat-placed")
    placed = placed.withColumn("tree", F.substring("path", 1, 16))
    # a tree that goes over several tasks: what the earlier tasks hold of it (one row for each task at most)
    held = placed.groupBy("tree", "task").agg(F.sum("chars").alias("held"))
    wide = held.join(held.groupBy("tree").agg(F.count("*").alias("n")).where("n > 1").select("tree"), "tree")
    carry = wide.select("tree", "task", F.expr("coalesce(sum(held) over (partition by tree order by task rows between unbounded preceding and 1 preceding), 0L)").alias("carry"))
    offset = placed.join(carry, ["tree", "task"], "left").withColumn("start", F.col("within") + F.coalesce("carry", F.lit(0)))
    placed = written(offset.select("tree", "path", "start", "chars", "position", "text", "loss"), "chat-offsets")

    above = placed.select("path", F.explode(F.expr(
        "transform(filter(sequence(16, cast(length(path) as int), 16), n -> n < length(path)), n -> substring(path, 1, n))")).alias("up"))
    spans = above.join(placed.select(F.col("path").alias("up"), F.struct("start", (F.col("start") + F.col("chars")).alias("end")).alias("span")), "up")
    attends = spans.groupBy("path").agg(F.sort_array(F.collect_list("span")).alias("attends"))
    segments = placed.join(attends, "path", "left").withColumn("attends", F.coalesce("attends", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")))
    leaves = parts.where("leaf").select(F.col("conv").alias(conv_col), "path")
    return written(segments, "chat-segments"), leaves


def _digested(id_type: pa.DataType):
    schema = pa.schema([("conv", id_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def done(conv, s):
        return conv, s["n"], s["turns"].hexdigest(), s["loss"], s["mask"].hexdigest(), s["chars"]

    def rows(batches):
        conv, s = NEW, None
        for c, text, loss in _rows(batches):
            if c != conv or conv is NEW:
                if s:
                    yield done(conv, s)
                conv, s = c, {"n": 0, "turns": hashlib.sha256(), "loss": 0, "mask": hashlib.sha256(), "chars": 0}
            s["chars"] += len(text)
            for role, body, _, _ in read_turns(text):
                s["n"] += 1
                s["turns"].update(f"{role}\n{body}\n".encode())
            for x in loss:
                shown = unescape(text[x["a"]:x["b"]])
                s["loss"] += len(shown)
                s["mask"].update(shown.encode())
        if s:
            yield done(conv, s)
    return lambda batches: _batches(rows(batches), schema)


def read_conversations(segments: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Every conversation read back: the tokens its last segment attends to, and its own.

    Returns ``conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. A
    segment that many conversations share is a skewed key of an equi-join.
    """
    leaf = conversations.select(F.col(conv_col).alias("conv"), "path").join(segments.select("path", "tree", "start", "attends"), "path")
    wanted = leaf.select("conv", "tree", F.explode(F.concat(F.transform("attends", lambda x: x["start"]), F.array("start"))).alias("start"))
    read = wanted.join(segments.select("tree", "start", "text", "loss"), ["tree", "start"])
    kind = read.schema["conv"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = (read.repartition(tasks, "conv").sortWithinPartitions("conv", "start").select("conv", "text", "loss")
           .mapInArrow(_digested(id_type), f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"))
    return out.withColumnRenamed("conv", conv_col)
