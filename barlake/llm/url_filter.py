"""URL filter by listed canonical URLs: blocked Bloom filter, then an exact hash join.

A listed entry is a canonical host and path prefix with a verdict. It fits its host and all
subdomains where the URL's path starts with the entry's path; the longest entry wins. A URL
therefore has one candidate key for each shape (number of host labels, length of path) that
the list holds. Every distinct canonical URL tests its candidates inside its own row against
a split-block Bloom filter: 256-bit blocks of four words, one bit of a key in each word, so a
test reads one block. Candidates that pass go on, one row each, to an exact equi-join with
the list, which removes the false positives. Everything is a built-in SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS_PER_BLOCK = 16          # 16 bits for each key
MAX_BLOCKS = 1 << 18         # 8 MB of filter; a longer list only raises the share of false positives


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _block(key: str, blocks: str) -> Column:
    return F.expr(f"cast(pmod(xxhash64({key}), {blocks}) as int)")


def _bit(key: str, word: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 'bits'), {6 * word}) & 63 as int))")


def bloom_filter(keys: DataFrame) -> DataFrame:
    """One row: ``blocks`` and ``words``, a sparse-free array of blocks (b, w0..w3) in order.

    ``keys`` has one column ``key``. The bits are or-ed per block before anything is gathered,
    and at most MAX_BLOCKS blocks exist, however long the list.
    """
    blocks = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.count("*") / KEYS_PER_BLOCK))).cast("int")
    counted = keys.agg(blocks.alias("blocks"))
    n = counted.scalar()
    bits = (keys.withColumn("blocks", n).withColumn("b", _block("key", "blocks"))
            .groupBy("b").agg(*[F.bit_or(_bit("key", i)).alias(f"w{i}") for i in range(4)]))
    every = keys.sparkSession.range(MAX_BLOCKS).select(F.col("id").cast("int").alias("b")).where(F.col("b") < n)
    full = every.join(bits, "b", "left").select("b", *[F.coalesce(f"w{i}", F.lit(0).cast("bigint")).alias(f"w{i}") for i in range(4)])
    return full.agg(F.sort_array(F.collect_list(F.struct("b", "w0", "w1", "w2", "w3"))).alias("words"))


def may_hold(words: str, key: str) -> str:
    """SQL text: whether the filter in column ``words`` may hold the string ``key``."""
    at = f"element_at({words}, cast(pmod(xxhash64({key}), size({words})) as int) + 1)"
    tests = [f"shiftrightunsigned({at}.w{i}, cast(shiftrightunsigned(xxhash64({key}, 'bits'), {6 * i}) & 63 as int)) & 1" for i in range(4)]
    return "(" + " & ".join(f"({t})" for t in tests) + ") = 1"


def judge_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with its canonical host and path, the entry that fits and a verdict.

    ``listed``: host, path, verdict (``allow`` or ``block``); a key listed with both verdicts
    blocks; null hosts or paths are ignored. Returns the columns of ``pages`` and then
    ``host, path, rule, verdict`` (columns of ``pages`` with one of those names are replaced).
    Defined cases: a null URL or one without ``://`` has an empty host and path and gets the
    default verdict, as does a URL that no entry fits; equal URLs are judged once and share the
    verdict; an empty list gives the default everywhere; an empty table gives no rows.
    """
    rules = (listed.where("host is not null and path is not null and host <> ''")
             .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
             .groupBy(F.concat("host", "path").alias("key"))
             .agg(F.max("verdict").alias("verdict"), F.max(F.size(F.split("host", r"\."))).alias("labels"),
                  F.max(F.length("path")).alias("length")))
    shapes = rules.agg(F.collect_set(F.struct("labels", "length"))).scalar()
    words = bloom_filter(rules.select("key")).scalar()

    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    named = pages.select(*own, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = named.select("host", "path").where("host <> ''").distinct()
    probes = (urls.withColumn("shapes", shapes).withColumn("words", words).withColumn("labels", F.split("host", r"\."))
              .withColumn("keys", F.expr(
                  "transform(filter(shapes, s -> s.labels <= size(labels) and s.length <= length(path)), s -> "
                  "concat(array_join(slice(labels, -s.labels, s.labels), '.'), substring(path, 1, s.length)))"))
              .select("host", "path", F.explode(F.expr(f"filter(keys, k -> {may_hold('words', 'k')})")).alias("key")))
    best = (probes.join(rules, "key").groupBy("host", "path")
            .agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best")))
    return (named.join(best, ["host", "path"], "left")
            .select(*own, "host", "path", F.col("best.key").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
