"""Spelling variants: words at edit distance 1, by an index of variable-length grams.

1. *Gram dictionary*, pruned by frequency: grams that occur more often than a share of all
   gram occurrences are too common to tell words apart. There can be no more of them than that
   share allows, so the dictionary is broadcast.
2. *Decomposition*: at each position a word has the shortest gram of at least `min_gram`
   characters that is not in the dictionary (or one of the greatest length, or one that the
   word's end cuts); grams that lie inside an earlier one are left out.
3. *Affected grams*: an edit at position i can change a word's gram only if
   end - longest <= i < look, where look is the last character the choice of the gram depended
   on. For each i these bounds leave a set of grams that the edited word has too: the grams
   before i at the same place, those behind i at the same distance from the end.
4. *List merging*: near words share all grams of the set of some i, so the lists of these grams
   are merged beforehand: one list for each set that a word has (about as many as it has grams)
   and each length of the longer word. Words of one length meet in the sets of a replacement, a
   word and one that is a character longer in the sets of an insertion and of a deletion, which
   are the same grams seen from either side. Two equi-joins of lists on one shuffle.
5. *Verification* in the join's condition: letters that occur an odd number of times differ in
   at most two, then the edit distance itself. No candidate pair leaves the join.

The longest gram is half the (shorter) word or less: then no edit can affect both a word's
first gram and its last, so no set is empty and the search is exact for every word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barlake.llm.text import U64, as_bytes, held, mix64, release, slices, tune
from barlake.session import written


@dataclass(frozen=True)
class Spelling:
    letters: str = "A-Za-zÀ-ÿ"
    min_chars: int = 7        # code points of a word
    min_count: int = 2        # occurrences of a word
    ratio: int = 10           # a form occurs at least ratio times as often
    min_gram: int = 2
    max_gram: int = 3
    dictionary: int = 2_000  # most grams of one length in the dictionary
    whole: int = 64           # characters of a word that its lists carry whole; longer ones by name
    held_words: int = 200_000  # words counted in a task before they are passed on

    def __post_init__(self):
        if self.min_chars < 2 * self.min_gram or self.max_gram < self.min_gram:
            raise ValueError("words need two grams: min_chars >= 2 * min_gram, max_gram >= min_gram")

    def longest(self, chars: int) -> int:
        """The longest gram for pairs whose shorter word has so many characters."""
        return min(self.max_gram, chars // 2)


# ---------------------------------------------------------------- words

def _passed(total: Counter, name: str) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=[name, "n"])
    total.clear()
    return batch


def _counting(params: Spelling, rewrite: Callable[[object, str], str] | None):
    def run(batches):
        release()
        find = re.compile(f"[{params.letters}]{{{params.min_chars},}}")
        total: Counter = Counter()

        for batch in slices(batches, "text"):
            for key, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                text = raw.lower().decode()  # bytes.lower() touches A-Z only
                words = Counter(find.findall(text) if len(text) < 1 << 20 else (m.group() for m in find.finditer(text)))
                if rewrite is None:
                    total.update(words)
                else:
                    for word, n in words.items():
                        new = rewrite(key, word)
                        if len(new) >= params.min_chars:
                            total[new] += n
                if len(total) >= params.held_words:
                    yield _passed(total, "word")
        yield _passed(total, "word")
    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Spelling = Spelling(),
                rewrite: Callable[[object, str], str] | None = None) -> DataFrame:
    """``word, n``: the maximal runs of letters, A-Z lower-cased, of all whole texts, with at least
    ``min_chars`` code points and ``min_count`` occurrences. ``rewrite(id, word)`` may replace a word
    of a text first (of words that are long enough before; the result counts if it still is)."""
    tune(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    found = src.mapInArrow(_counting(params, rewrite), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= params.min_count)


# ---------------------------------------------------------------- grams

def _gram_counting(params: Spelling):
    def run(batches):
        release()
        total: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for q in range(params.min_gram, params.max_gram):
                    total.update(word[p:p + q] for p in range(len(word) - q + 1))
                if len(total) >= params.held_words:
                    yield _passed(total, "gram")
        yield _passed(total, "gram")
    return run


def gram_dictionary(words: DataFrame, params: Spelling = Spelling()) -> set[str]:
    """The grams below the greatest length that occur more often than 1 / dictionary of all
    grams of their length: fewer than ``dictionary`` of each length."""
    counts = words.select("word").mapInArrow(_gram_counting(params), "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    total = counts.groupBy(F.length("gram").alias("size")).agg(F.sum("n").alias("total"))
    frequent = counts.join(F.broadcast(total), F.length("gram") == F.col("size")).where(F.col("n") * params.dictionary > F.col("total"))
    return {gram for gram, in frequent.select("gram").collect()}


MASK = (1 << 64) - 1
PLACES = [int(x) | 1 for x in mix64(np.arange(1, 4097, dtype=U64))]  # an odd factor for each place of a gram


class Decomposer:
    """Variable grams of words under a dictionary, for one greatest length."""

    def __init__(self, frequent: set[str], shortest: int, longest: int):
        self.frequent, self.shortest, self.longest = frequent, shortest, longest
        self.known: dict[str, tuple[int, int, int]] = {}

    def at(self, window: str) -> tuple[int, int, int]:
        """length, look, hash of the gram that a window of at most `longest` characters begins with."""
        size = self.shortest
        while size < self.longest and size < len(window) and window[:size] in self.frequent:
            size += 1
        cut = size < self.longest and window[:size] in self.frequent  # the end of the word cut it
        found = size, size + cut, xxhash.xxh64_intdigest(window[:size])
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[window] = found
        return found

    def grams(self, word: str) -> list[tuple[int, int, int, int]]:
        """(start, end, look, hash) by start; spans inside an earlier one are left out."""
        out, reach, known, longest = [], 0, self.known, self.longest
        for p in range(len(word) - self.shortest + 1):
            window = word[p:p + longest]
            size, look, h = known.get(window) or self.at(window)
            if p + size > reach:
                reach = p + size
                out.append((p, reach, p + look, h))
        return out

    def lists(self, word: str) -> tuple[set[int], set[int]]:
        """Names of the sets of grams that no replacement (or deletion) at some place affects, and
        of those that no insertion does."""
        grams, chars, longest = self.grams(word), len(word), self.longest
        if chars < 2 * longest:
            raise ValueError(f"words of {chars} characters have no bound with grams of {longest}")
        before, behind = [0], [0]
        for p, _, _, h in grams:
            before.append(before[-1] + h * PLACES[p & 4095])
        for p, _, _, h in reversed(grams):
            behind.append(behind[-1] + h * PLACES[(chars - p) & 4095])
        behind.reverse()
        replaced, inserted = set(), set()
        n, left, right = len(grams), 0, 0
        while grams[right][1] < longest:  # grams behind an insertion before the first character
            right += 1
        for i in range(chars + 1):
            while left < n and grams[left][2] <= i:
                left += 1
            inserted.add((before[left] + 3 * behind[right]) & MASK)
            while right < n and (grams[right][0] <= i or grams[right][1] <= i + longest):
                right += 1
            if i < chars:
                replaced.add((before[left] + 3 * behind[right]) & MASK)
        return replaced, inserted


def _named(sets: list[tuple[int, int, int]]) -> np.ndarray:
    """64-bit list names of (set, characters of the longer word, greatest gram)."""
    flat = np.array(sets, dtype=U64).reshape(-1, 3)
    return mix64(flat[:, 0] ^ mix64((flat[:, 1] << U64(8)) ^ flat[:, 2])).view(np.int64)


def _listing(shared, params: Spelling):
    key = shared._jbroadcast.id()

    def parity(word: str) -> int:
        bits = 0
        for c in word:
            bits ^= 1 << (ord(c) & 63)
        return bits - (1 << 64) if bits >> 63 else bits

    def run(batches):
        parts = held(("grams", key), lambda: {q: Decomposer(shared.value, params.min_gram, q) for q in range(params.min_gram, params.max_gram + 1)})
        for batch in batches:
            own, probes, own_ends, probe_ends, odd = [], [], [0], [0], []
            for word in batch.column(0).to_pylist():
                chars = len(word)
                q = params.longest(chars)
                replaced, inserted = parts[q].lists(word)
                own += [(x, chars, q) for x in replaced]
                probes += [(x, chars + 1, q) for x in inserted]
                if chars > params.min_chars and params.longest(chars - 1) != q:  # the grams of pairs with a shorter word
                    q = params.longest(chars - 1)
                    own += [(x, chars, q) for x in parts[q].lists(word)[0]]
                own_ends.append(len(own))
                probe_ends.append(len(probes))
                odd.append(parity(word))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_named(flat))) for ends, flat in ((own_ends, own), (probe_ends, probes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odd, pa.int64()), *lists],
                                             names=["word", "n", "odd", "own", "longer"])
    return run


def near_pairs(words: DataFrame, params: Spelling = Spelling()) -> DataFrame:
    """``a, na, b, nb``: the pairs of distinct words one edit apart, each once, with their counts.

    ``words`` holds distinct ``word`` of at least ``min_chars`` characters, and ``n``."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(gram_dictionary(words, params))
    lists = words.select("word", "n").mapInArrow(_listing(shared, params), "word string, n bigint, odd bigint, own array<bigint>, longer array<bigint>")
    lists = written(lists.select("*", F.char_length("word").alias("chars"), F.xxhash64("word").alias("id")), "gram-lists")

    chars, whole = F.col("chars"), params.whole

    def listed(column: str, end: str, which, *carried) -> DataFrame:
        return lists.where(which).select(F.explode(column).alias(f"key_{end}"), F.col("odd").alias(f"odd_{end}"), *carried)

    def words_of(end: str):
        return F.col("word").alias(end), F.col("n").alias(f"n{end}")

    def name_of(end: str):
        return F.col("id").alias(f"id_{end}"),

    def joined(column: str, which_a, which_b, carried, condition) -> DataFrame:
        near = (F.col("key_a") == F.col("key_b")) & (F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2)
        return listed(column, "a", which_a, *carried("a")).join(listed("own", "b", which_b, *carried("b")), near & condition)

    one_edit = F.levenshtein("a", "b", 1) == 1
    once = F.when(F.char_length("a") == F.char_length("b"), F.col("a") < F.col("b")).otherwise(True)
    near = joined("own", chars <= whole, chars <= whole, words_of, once & one_edit)
    near = near.unionByName(joined("longer", chars < whole, chars <= whole, words_of, one_edit)).select("a", "na", "b", "nb").distinct()
    # a very long word has as many lists as characters: its rows carry a name, its letters come at last
    names = joined("own", chars > whole, chars > whole, name_of, F.lit(True)).unionByName(
        joined("longer", chars >= whole, chars > whole, name_of, F.lit(True))).select("id_a", "id_b").distinct()
    texts = lists.where(chars >= whole).select("id", "word", "n")
    far = names.join(texts.select(*name_of("a"), *words_of("a")), "id_a").join(texts.select(*name_of("b"), *words_of("b")), "id_b")
    return near.unionByName(far.where(once & one_edit).select("a", "na", "b", "nb").distinct())


# ---------------------------------------------------------------- variants

def variants(words: DataFrame, params: Spelling = Spelling()) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words`` (distinct ``word``, ``n``).

    A word's form is its near word of greatest count (ties: smallest in code-point order), if it
    occurs at least ``ratio`` times as often; else null. The root is reached by following forms;
    a chain's counts grow by ``ratio`` at each step, so it has few steps. Words with a null word
    or count, or fewer than ``min_chars`` characters, are left out; an empty table gives no rows.
    """
    words = written(words.select("word", "n").where(F.col("n").isNotNull() & (F.char_length("word") >= params.min_chars)), "words")
    pairs = written(near_pairs(words, params), "near")
    both = pairs.select(F.col("a").alias("word"), "na", F.col("b").alias("near"), "nb").unionByName(
        pairs.select(F.col("b").alias("word"), F.col("nb").alias("na"), F.col("a").alias("near"), F.col("na").alias("nb")))
    best = both.groupBy("word", "na").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("c"), "near")).alias("top"))
    form_n = -F.col("top.c")
    chosen = best.select("word", "n_near", F.when(form_n >= params.ratio * F.col("na"), F.struct(F.col("top.near").alias("form"), form_n.alias("form_n"))).alias("f"))
    chosen = written(chosen.select("word", "n_near", "f.form", "f.form_n"), "forms")
    root = _roots(chosen.where("form is not null").select("word", F.col("form").alias("root")))
    return (words.join(chosen, "word", "left").join(root, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n"))


def _roots(links: DataFrame) -> DataFrame:
    """word -> the end of its chain, each round twice as far as the one before."""
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return links


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Spelling = Spelling(),
                      rewrite: Callable[[object, str], str] | None = None) -> DataFrame:
    """Variants of the words of all whole texts: see :func:`count_words` and :func:`variants`.

    Null and empty texts have no words; ids may be null or repeat (each row is a text of its own);
    other columns are ignored; an empty table gives no rows. Runs jobs when called; the
    words, their lists and the pairs are tables in the shared folder.
    """
    return variants(count_words(docs, id_col, text_col, params, rewrite), params)
