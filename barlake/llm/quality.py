"""Quality rules whose cutoffs carry a guarantee on false rejections.

Each rule compares a count with the number of words of a text. Its cutoff comes from labelled
holdout documents: per stratum, a cutoff is certified when the exact binomial bound says that
good documents are rejected at a rate of at most `alpha / rules`:

    P(Binomial(n good documents, alpha / rules) <= rejected good documents) <= level.

Cutoffs of one rule and stratum are tested from the loosest to the strictest, stopping at the
first that fails (fixed-sequence testing), and `level` is `delta` shared out over all chains
(Bonferroni over strata times rules). So with probability 1 - delta no stratum loses more than
`alpha` of its good documents. Among the certified cutoffs the one is taken that rejects most
bad documents for the good ones it costs; a stratum with too few labels certifies none, and
nothing is rejected there beyond the base rules. Built-in SQL expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from barlake.session import written

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

#: Rule -> SQL text of its statistic, 0 (harmless) to 63, integer arithmetic only. With w words:
#: long words, short words, symbols, repeated lines and repeated three-word windows.
RULES = {
    "long_words": "least(63, 4 * word_chars div n_words)",
    "short_words": "greatest(0, 63 - 8 * word_chars div n_words)",
    "symbols": "least(63, 32 * n_symbols div n_words)",
    "dup_lines": "least(63, 200 * n_dup_lines div n_words)",
    "repeat_words": "least(63, 64 * n_repeat_words div n_words)",
}
#: A bad document caught must weigh up this many times its share in good ones.
PRICE = 10


@dataclass(frozen=True)
class Risk:
    alpha: float = 0.05
    delta: float = 0.10


def counts(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated windows: the hashes of a text's three-word windows are sorted together with their
    positions, in the low 24 bits or as many as the text needs; equal neighbours are repeats,
    and their sorted positions give the covered words. One pass, no shuffle, any length.
    """
    base = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = base.select(*keep, "text", F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "").alias("words"),
                      F.filter(F.split("text", "\n"), lambda line: line.rlike(NOT_SPACE)).alias("lines"))
    sized = cut.select(
        *keep, "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    hashed = sized.withColumn("bits", F.expr("cast(length(bin(n_words)) as int)")).withColumn("grams", F.expr(
        "case when n_words < 3 then cast(array() as array<bigint>) else "
        "transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) end"))
    ordered = hashed.withColumn("sorted", F.expr(
        "case when size(array_distinct(grams)) = size(grams) then cast(array() as array<bigint>) else "
        "sort_array(transform(grams, (h, i) -> shiftleft(h, bits) | i)) end"))
    places = ordered.withColumn("at", F.expr(
        "sort_array(transform(filter(sorted, (x, i) -> (i > 0 and shiftright(sorted[i - 1], bits) = shiftright(x, bits)) or "
        "(i < size(sorted) - 1 and shiftright(sorted[i + 1], bits) = shiftright(x, bits))), x -> x & (shiftleft(1L, bits) - 1)))"))
    covered = F.expr("aggregate(at, named_struct('n', 0L, 'last', -3L), "
                     "(s, p) -> named_struct('n', s.n + least(3L, p - s.last), 'last', p), s -> s.n)")
    return places.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


def _tail(n: str, k: str, p: str) -> str:
    """SQL text of P(Binomial(n, p) <= k) for k < n * p: the largest term by logarithms, the
    others relative to it by their ratios, so nothing underflows."""
    log_top = (f"(aggregate(case when {k} = 0 then cast(array() as array<bigint>) else sequence(1L, {k}) end, 0D, "
               f"(s, i) -> s + ln(({n} - i + 1) / i)) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))")
    ratios = (f"aggregate(case when {k} = 0 then cast(array() as array<bigint>) else sequence(0L, {k} - 1) end, "
              f"named_struct('s', 1D, 't', 1D), (a, j) -> named_struct('s', a.s + a.t * (({k} - j) / ({n} - {k} + j + 1) * (1 - {p}) / {p}), "
              f"'t', a.t * (({k} - j) / ({n} - {k} + j + 1) * (1 - {p}) / {p})), a -> a.s)")
    return f"(exp({log_top}) * {ratios})"


def cutoffs(labelled: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """``stratum, quality`` and the counts of base-passing labelled rows -> ``stratum, rule, cutoff``.

    A row of a rule is rejected from the cutoff upward; chains that certify nothing are absent.
    Only histograms of 64 cells per stratum and rule are ever gathered.
    """
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.expr(f"cast({sql} as int)").alias("s"))
                                for name, sql in RULES.items()]))
    cells = (labelled.select("stratum", "quality", rules.alias("r")).groupBy("stratum", F.col("r.rule").alias("rule"), F.col("r.s").alias("s"))
             .agg(F.expr("count_if(quality = 1)").alias("good"), F.expr("count_if(quality = 0)").alias("bad")))
    n = cells.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.sum("bad").alias("n_bad"))
    chains = n.agg(F.greatest(F.lit(1), F.count("*"))).scalar()
    # every cutoff 1..63 of a chain, with the good and bad documents at or above it
    grid = n.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(63))))
    full = grid.join(cells, ["stratum", "rule", "s"], "left").fillna(0, ["good", "bad"])
    above = full.select("*", F.expr("sum(good) over (partition by stratum, rule order by s desc)").alias("k"),
                        F.expr("sum(bad) over (partition by stratum, rule order by s desc)").alias("k_bad"))
    p = f"{risk.alpha / len(RULES)!r}D"
    tested = above.withColumn("level", F.lit(risk.delta) / chains).withColumn(
        "ok", F.expr(f"k < n * {p} and case when k < n * {p} then {_tail('n', 'k', p)} else 1D end <= level"))
    chain = tested.withColumn("certified", F.expr("min(ok) over (partition by stratum, rule order by s desc)"))
    gain = F.col("k_bad") / F.greatest("n_bad", F.lit(1)) - PRICE * F.col("k") / F.greatest("n", F.lit(1))
    best = (chain.where("certified").withColumn("gain", gain).groupBy("stratum", "rule")
            .agg(F.max(F.struct("gain", "s")).alias("best")))
    return best.where("best.gain > 0").select("stratum", "rule", F.col("best.s").alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang", label_col: str = "quality", risk: Risk = Risk()) -> DataFrame:
    """Counts, base rule and verdict of every document.

    Returns ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, rule``; ``rule`` names the first rule that rejects. Labels (1 good, 0 bad) are read
    from ``labels`` by id; several labels of an id count as its worst, null labels and labels of
    unknown ids are ignored. Defined cases: a null or empty text has no words and fails the base
    rule; a null stratum is a stratum of its own (''); null ids have no label; repeated rows are
    judged each; empty tables give no rows, or no cutoffs; other columns are ignored.
    """
    renamed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                          F.col(text_col).alias("body"))
    found = written(counts(renamed, "body", "id", "stratum").withColumn("base_failed", F.expr(BASE_FAILED)), "quality")
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("quality")).where("quality in (0, 1)")
    marks = marks.groupBy("id").agg(F.min("quality").alias("quality"))
    limits = cutoffs(found.where("not base_failed").join(marks, "id"), risk)
    by_stratum = limits.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    judged = found.join(by_stratum, "stratum", "left")
    rule = F.coalesce(*[F.when(F.expr(f"not base_failed and cast({sql} as int) >= cut_{r}"), F.lit(r)) for r, sql in RULES.items()])
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", rule.alias("rule")).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
