"""Line dedup: repeated windows of three consecutive lines, over the whole corpus.

Web text holds whole paragraphs in one physical line, so a line here ends at a line break, at
a sentence end, after a word whose last character is one of `ENDS` or `MORE_ENDS` (about one word
in six) and, where none of these comes, after `wrap` words. Ends chosen by the words themselves
fall on the same words in every copy of a passage, whatever stands before it. Every text is cut
into lines that together are exactly the text. Each run of three lines has one hash. A hash that occurs more
than once keeps its first occurrence (smallest id, then first in the text); all later ones are
covered. Covered lines are merged into spans, and spans of `min_words` words or more leave.

Repeats inside a text are found within its row, so only the first occurrence per text takes
part in the shuffles. Every text is cut once and its window hashes are written. One aggregation
(a frequent window is reduced before it moves) finds the windows of several texts; a bit filter of
these, of bounded size, spares the other windows the shuffle of the equi-join that leads
back to the texts, which adaptive execution splits where skewed. Only texts with covered lines are
cut again. Built-in SQL expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barlake.session import discard, written

WHITE = r"\x20\x09-\x0D"
#: Last characters of the words that end a line inside a sentence: comma, colons, two letters and two digits; and
#: beyond Latin-1 the Arabic comma and semicolon and letters of the Cyrillic, Greek, Hebrew, Arabic and Devanagari scripts.
ENDS = ",;:ro05"
MORE_ENDS = "،؛аиςהةنे"
HASHES_PER_BLOCK = 16    # of the filter: blocks of 256 bits, one bit of a hash in each of four words
MAX_BLOCKS = 1 << 19     # 16 MB; more hashes only let more windows pass to the exact join


@dataclass(frozen=True)
class LineDedup:
    window: int = 3
    wrap: int = 10       # words after which a line without any other end is broken
    min_words: int = 20  # shorter covered spans stay: headings, licence lines, stock phrases

    @property
    def line(self) -> str:
        """Pattern of one line with the white space around it, the same for RE2 and Java."""
        return self._line(ENDS + MORE_ENDS)

    @property
    def latin_line(self) -> str:
        """The same lines for texts without `MORE_ENDS`; a class within Latin-1 takes Java half the time."""
        return self._line(ENDS)

    def _line(self, ends: str) -> str:
        return rf"[{WHITE}]*(?:[^{WHITE}]*[^{WHITE}.!?{ends}][\x20\x09]+){{0,{self.wrap - 1}}}[^{WHITE}]+[{WHITE}]*"


def lines_of(text: Column, p: LineDedup) -> Column:
    other = reduce(Column.__or__, [text.contains(c) for c in MORE_ENDS])
    return (F.when(other, F.regexp_extract_all(text, F.lit(p.line), F.lit(0)))
            .otherwise(F.regexp_extract_all(text, F.lit(p.latin_line), F.lit(0))))


def windows(docs: DataFrame, p: LineDedup) -> DataFrame:
    """``id, lines`` -> ``id, hashes`` of the windows at each line, ``firsts``: the lines of first
    occurrences in the text, and ``own``: the lines at which a window of the text occurs again.

    Hashes and positions are sorted together in one array of longs, the position in as many
    low bits as the text needs; equal neighbours are repeats.
    """
    hashed = docs.select("id", F.transform("lines", lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))).alias("h"))
    runs = ", ".join(f"h[i + {j}]" for j in range(p.window))
    grams = hashed.select("id", F.expr(
        f"case when size(h) < {p.window} then cast(array() as array<bigint>) "
        f"else transform(sequence(0, size(h) - {p.window}), i -> xxhash64({runs})) end").alias("hashes"))
    sized = grams.withColumn("bits", F.expr("length(bin(size(hashes)))"))
    ordered = sized.withColumn("sorted", F.expr(
        "case when size(array_distinct(hashes)) = size(hashes) then cast(array() as array<bigint>) "
        "else sort_array(transform(hashes, (h, i) -> shiftleft(h, bits) | i)) end"))
    again = "i > 0 and shiftright(sorted[i - 1], bits) = shiftright(x, bits)"
    place = "x -> cast(x & (shiftleft(1L, bits) - 1) as int)"
    return ordered.select(
        "id", "hashes", F.expr(f"transform(filter(sorted, (x, i) -> {again}), {place})").alias("own"),
        F.expr("case when size(hashes) = 0 then cast(array() as array<int>) when size(sorted) = 0 then sequence(0, size(hashes) - 1) "
               f"else transform(filter(sorted, (x, i) -> not ({again})), {place}) end").alias("firsts"))


def _bit(word: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(w, {6 * word}) & 63 as int))")


def maybe_among(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The ``rows`` whose 64-bit hash ``w`` may be among ``hashes`` (column ``w``): all that are, and of
    the others about one in 400 while the filter is not full.

    The filter's blocks are a table of at most MAX_BLOCKS rows of five numbers, which is what is
    broadcast, however many the hashes are."""
    n = max(1, min(MAX_BLOCKS, -(-hashes.count() // HASHES_PER_BLOCK)))
    block = F.pmod(F.expr("shiftrightunsigned(w, 24)"), F.lit(n))
    bits = hashes.groupBy(block.alias("b")).agg(*[F.bit_or(_bit(i)).alias(f"x{i}") for i in range(4)])
    near = rows.join(F.broadcast(bits), block == F.col("b"))
    for i in range(4):
        near = near.where(F.col(f"x{i}").bitwiseAND(_bit(i)) != 0)
    return near.select(*rows.columns)


def covered_texts(docs: DataFrame, p: LineDedup) -> DataFrame:
    """``id, rows, lines, own, at``: for each id its rows, their most lines, the lines at which a window
    of its text begins that occurs before in the same text (of one of its rows, if they are several),
    and those at which one begins that a text of smaller id has (null: none). Written; what led to it
    is deleted."""
    cut = docs.select("id", lines_of(F.col("text"), p).alias("lines"))
    found = windows(cut.select(F.struct("id", F.size("lines").alias("n")).alias("id"), "lines"), p)
    everywhere = F.size("firsts") == F.size("hashes")
    found = written(found.select("id.id", F.col("id.n").alias("n"), "hashes", F.when(~everywhere, F.col("firsts")).alias("firsts"), "own"), "line-windows")
    rows = found.select("id", F.inline(F.expr(
        "transform(coalesce(firsts, if(size(hashes) = 0, cast(array() as array<int>), sequence(0, size(hashes) - 1))), "
        "q -> named_struct('pos', q, 'w', hashes[q]))")))
    first = rows.groupBy("w").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("w", "first")
    first = written(first, "line-firsts")
    later = maybe_among(rows, first).join(first, "w").where("id > first").groupBy("id").agg(F.collect_set("pos").alias("at"))
    per_id = found.groupBy("id").agg(F.count("*").alias("rows"), F.max("n").alias("lines"), F.max("own").alias("own"))
    marks = written(per_id.where("id is not null").join(later, "id", "left"), "line-marks")
    discard(found, first)
    return marks


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: LineDedup = LineDedup()) -> DataFrame:
    """The documents with every repeated passage left in its first place only.

    Returns the columns of ``docs`` with ``text_col`` shortened, and then ``n_lines, n_removed``
    (columns of those names are replaced). All other bytes of a text stay as they are. Defined
    cases: null stays null, an empty text empty, both with 0 lines; a text of fewer than three
    lines is never changed; rows that share an id are one document's copies and do not remove
    from each other; a row with a null id is only rid of its own repeats; an empty table gives
    no rows; any length is handled, a text's lines being the largest thing held at once.
    """
    p = params
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    src = docs.select(F.col(id_col).alias("id"), F.struct(*own).alias("row"))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = covered_texts(slim, p).withColumnRenamed("lines", "known")
    joined = src.join(marks, "id", "left")
    # rows without an id are known only by what they repeat themselves, rows that share one not one by one
    joined = joined.withColumn("own", F.when(F.col("rows") == 1, F.col("own")))
    touched = F.col("at").isNotNull() | F.col("own").isNull() | (F.size("own") > 0)
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    joined = joined.select("row", "at", F.when(~touched, F.col("known")).alias("known"), F.col("own").alias("found"),
                           F.when(touched, lines_of(text, p)).otherwise(F.array().cast("array<string>")).alias("lines"))
    return _without(joined, own, text_col, p)


def _without(joined: DataFrame, own: list[str], text_col: str, p: LineDedup) -> DataFrame:
    """Cuts the covered spans out: spans are runs of covered lines, found from their ends. Windows are
    hashed again only for the rows whose own repeats are not known yet."""
    unknown = F.when(F.col("found").isNull(), F.col("lines")).otherwise(F.array().cast("array<string>"))
    inner = windows(joined.select(F.struct("row", "at", "known", "found", "lines").alias("id"), unknown.alias("lines")), p)
    covered = inner.select("id.*", F.expr(
        f"array_sort(array_distinct(flatten(transform(concat(coalesce(id.found, own), coalesce(id.at, cast(array() as array<int>))), q -> sequence(q, q + {p.window - 1})))))").alias("c"))
    spans = covered.select("row", "known", "lines", F.expr(
        "arrays_zip(filter(c, (q, i) -> i = 0 or c[i - 1] <> q - 1), filter(c, (q, i) -> i = size(c) - 1 or c[i + 1] <> q + 1))").alias("z"))
    words = F.expr("transform(z, s -> named_struct('a', s['0'], 'b', s['1'], 't', array_join(slice(lines, s['0'] + 1, s['1'] - s['0'] + 1), '')))")
    cut = spans.select("row", "known", "lines", words.alias("z")).select("row", "known", "lines", F.filter(
        "z", lambda s: F.regexp_count(s["t"], F.lit(f"[^{WHITE}]+")) >= p.min_words).alias("z"))
    parts = cut.select("row", "known", "lines", "z", F.expr(
        "transform(sequence(0, size(z)), i -> array_join(slice(lines, if(i = 0, 1, z[i - 1].b + 2), "
        "if(i = size(z), size(lines), z[i].a) - if(i = 0, 0, z[i - 1].b + 1)), ''))").alias("parts"))
    text = F.when(F.size("z") == 0, F.col(f"row.{text_col}")).otherwise(F.array_join("parts", ""))
    removed = F.expr("aggregate(z, 0L, (n, s) -> n + s.b - s.a + 1)")
    return parts.select(*[(text if c == text_col else F.col(f"row.{c}")).alias(c) for c in own],
                        F.coalesce("known", F.size("lines")).cast("long").alias("n_lines"), removed.alias("n_removed"))
