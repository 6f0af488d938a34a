"""b-bit MinHash near-duplicate detection.

1. One pass over the texts: distinct word shingles as 64-bit hashes, `k` minima, of
   which only the low `bits` are kept and packed (the b-bit signature), and one 64-bit
   key for each band of `rows` full minima.
2. Equal sets collapse to one representative before anything else.
3. Band keys held by two or more representatives are the candidate buckets. A bucket is
   never expanded into its pairs: workers compare packed signatures block by block with
   bit counts, correct the estimate for chance collisions of the low bits
   (J = (P - 2^-b) / (1 - 2^-b)), and emit a maximum spanning forest of the block.
4. Emitted pairs are confirmed on the full shingle sets; confirmed ones give components.
5. Pairs of a bucket whose estimate passes but which still lie in different components
   are emitted in a second wave and confirmed too, so no link found by any band is lost.

The estimate only discards pairs more than `sigmas` standard errors below the threshold.
With the defaults a pair at similarity 0.8 shares no band with probability 8e-6, and is
discarded by its estimate with probability 3e-5.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barlake.llm.components import components
from barlake.llm.text import U64, WordHashes, as_bytes, mix64, release, shingle_set, slices, tune
from barlake.session import written


@dataclass(frozen=True)
class MinHash:
    shingle: int = 5
    percent: int = 80        # link when 100 * intersection >= percent * union
    rows: int = 8
    bands: int = 64
    bits: int = 2
    sigmas: float = 4.0
    block: int = 4096        # bucket members one work unit compares with another such block
    seed: int = 0x5EED

    @property
    def k(self) -> int:
        return self.rows * self.bands

    @property
    def least_agreements(self) -> int:
        """Signature agreements below which a pair cannot be a link, `sigmas` errors apart."""
        chance = 2.0 ** -self.bits
        p = chance + (1 - chance) * self.percent / 100
        return math.floor(self.k * p - self.sigmas * math.sqrt(self.k * p * (1 - p)))


def _hash_family(p: MinHash) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    return (rng.integers(0, 1 << 32, p.k, dtype=np.uint32),
            rng.integers(0, 1 << 31, p.k, dtype=np.uint32) * np.uint32(2) + np.uint32(1))


def minima(sets: list[np.ndarray], p: MinHash) -> np.ndarray:
    """(len(sets), k) 32-bit minima; every set holds at least one shingle."""
    xors, odds = _hash_family(p)
    out = np.empty((len(sets), p.k), np.uint32)
    start = 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (stop == start or size + len(sets[stop]) <= 32_768):
            size += len(sets[stop])
            stop += 1
        x = (np.concatenate(sets[start:stop]) >> U64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[start:stop - 1]], dtype=np.int64)]).astype(np.int64)
        buf = np.empty_like(x)
        for i in range(p.k):
            np.bitwise_xor(x, xors[i], out=buf)
            np.multiply(buf, odds[i], out=buf)
            out[start:stop, i] = np.minimum.reduceat(buf, at)
        start = stop
    return out


def band_keys(m: np.ndarray, p: MinHash) -> np.ndarray:
    """One 64-bit key for each band, the band's number mixed in."""
    key = np.broadcast_to(np.arange(p.bands, dtype=U64), (len(m), p.bands)).copy()
    cube = m.reshape(len(m), p.bands, p.rows)
    for r in range(p.rows):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + cube[:, :, r].astype(U64) + U64(1))
    return key


def signature(m: np.ndarray, p: MinHash) -> np.ndarray:
    """Packed low bits of the minima, bit plane by bit plane: (n, bits * k / 8) bytes."""
    low = (m * np.uint32(0x85EBCA6B)) >> np.uint32(32 - p.bits)  # mixed first: minima share low zeros
    planes = [np.packbits(((low >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=1) for b in range(p.bits)]
    return np.concatenate(planes, axis=1)


def agreements(one: np.ndarray, many: np.ndarray, p: MinHash) -> np.ndarray:
    """In how many of the k places the low bits agree; signatures as uint64 words."""
    diff = one ^ many
    words = diff.shape[-1] // p.bits
    any_plane = diff[..., :words]
    for b in range(1, p.bits):
        any_plane = any_plane | diff[..., b * words:(b + 1) * words]
    return p.k - np.bitwise_count(any_plane).sum(axis=-1, dtype=np.int64)


def _signing(p: MinHash):
    def run(batches):
        release()
        hashes = WordHashes(p.seed, 200_000)
        for batch in slices(batches, "text"):
            sets = [shingle_set(hashes.of(t.lower().split()) if t else np.zeros(0, U64), p.shingle)
                    for t in as_bytes(batch.column(1))]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, sigs, digest = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                m = minima([sets[i] for i in full], p)
                bands, packed = band_keys(m, p).view(np.int64), signature(m, p)
                for j, i in enumerate(full):
                    keys[i], sigs[i] = bands[j], packed[j].tobytes()
                    digest[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "digest", "sig", "keys"])
    return run


def signatures(docs: DataFrame, id_col: str, text_col: str, p: MinHash) -> DataFrame:
    """id, n_shingles, digest of the set, packed signature, band keys; null where the set is empty."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_signing(p), f"id {kind}, n_shingles bigint, digest binary, sig binary, keys array<bigint>")


def _forest(sig, comp, keys, key, p: MinHash):
    """Maximum spanning forest (Prim) over pairs whose estimate passes; memory O(members)."""
    n, least = len(sig), p.least_agreements
    best, parent = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    out = np.zeros(n, bool)
    cur, edges = 0, []
    for _ in range(n):
        out[cur] = True
        if best[cur] >= least:
            edges.append((parent[cur], cur))
        score = agreements(sig[cur], sig, p)
        better = ~out & (score > best)
        best[better], parent[better] = score[better], cur
        cur = int(np.argmax(np.where(out, -2, best)))
    return edges


def _cross(sig, comp, keys, key, p: MinHash):
    """Every pair of different components whose estimate passes, from the first bucket that
    both are in: a pair that shares many bands is emitted once."""
    band = int(np.flatnonzero((keys == key).any(axis=0))[0])
    edges = []
    for i in range(len(sig) - 1):
        other = np.flatnonzero(comp[i + 1:] != comp[i]) + i + 1
        if len(other):
            hit = other[agreements(sig[i], sig[other], p) >= p.least_agreements]
            if band and len(hit):
                hit = hit[~(keys[hit, :band] == keys[i, :band]).any(axis=1)]
            edges += [(i, j) for j in hit]
    return edges


def _comparing(p: MinHash, pairs_of):
    """Groups arrive sorted by (key, lo, hi); a group is at most two blocks of members."""
    def run(batches):
        release()
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            rest, ready = _split_last(table)
            if ready is not None:
                yield from _pairs(ready, p, pairs_of)
        if rest is not None:
            yield from _pairs(rest, p, pairs_of)
    return run


def _group_starts(t) -> np.ndarray:
    cols = [t.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi")]
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _split_last(table: pa.Table):
    """(rows of the last group, the complete groups before it)."""
    if table.num_rows == 0:
        return None, None
    last = int(_group_starts(table)[-1])
    parts = table.slice(last).combine_chunks().to_batches(), table.slice(0, last).combine_chunks().to_batches()
    return parts[0][0], (parts[1][0] if last else None)


def _pairs(batch: pa.RecordBatch, p: MinHash, pairs_of):
    column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    ids, width = column["id"], p.bits * p.k // 8
    sig = np.frombuffer(b"".join(column["sig"].to_pylist()), U64).reshape(-1, width // 8)
    comp, key = (column[c].to_numpy(zero_copy_only=False) for c in ("comp", "key"))
    keys = column["keys"].flatten().to_numpy().reshape(-1, p.bands) if "keys" in column else None
    starts = _group_starts(batch)
    sizes = np.diff(np.append(starts, batch.num_rows))
    left, right = [], []
    if keys is None:  # pairs alone, the most frequent case, are compared all at once
        two = starts[sizes == 2]
        ok = agreements(sig[two], sig[two + 1], p) >= p.least_agreements
        left, right = list(two[ok]), list(two[ok] + 1)
        starts, sizes = starts[sizes > 2], sizes[sizes > 2]
    for s, n in zip(starts, sizes):
        for i, j in pairs_of(sig[s:s + n], comp[s:s + n], None if keys is None else keys[s:s + n], key[s], p):
            left.append(s + i)
            right.append(s + j)
    if left:
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(left, pa.int64())), ids.take(pa.array(right, pa.int64()))],
                                         names=["a", "b"])


def bucket_members(sigs: DataFrame, p: MinHash) -> DataFrame:
    """(key, size, id) for every band key that at least two representatives hold."""
    rows = sigs.select("id", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(shared, "key")


def candidate_pairs(members: DataFrame, p: MinHash, pairs_of) -> DataFrame:
    """Distinct (a, b) that pass the signature estimate within a bucket.

    ``members``: key, size, id, sig, comp and, for :func:`_cross`, keys. A bucket beyond ``block`` members is cut into
    blocks by id, and each pair of blocks is its own work unit, whatever the bucket's size.
    """
    kind = members.schema["id"].dataType.simpleString()
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / p.block)).cast("int")
    dealt = (members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
                     *[c for c in members.columns if c != "size"][1:]))
    pairs = (dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
             .mapInArrow(_comparing(p, pairs_of), f"a {kind}, b {kind}"))
    return (pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .where("a <> b").distinct())


def _confirming(p: MinHash):
    def run(batches):
        release()
        hashes = WordHashes(p.seed, 200_000)
        for batch in batches:
            keep, last = [], (None, None)
            for i, (ta, tb) in enumerate(zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)))):
                if last[0] is not tb and last[0] != tb:
                    last = (tb, shingle_set(hashes.of(tb.lower().split()), p.shingle))
                sa, sb = shingle_set(hashes.of(ta.lower().split()), p.shingle), last[1]
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if 100 * both >= p.percent * (len(sa) + len(sb) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])
    return run


def confirmed(pairs: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. A text that stands in many
    pairs is a skewed key of an equi-join, which adaptive execution splits."""
    kind = pairs.schema["a"].dataType.simpleString()
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_confirming(p), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    params: MinHash = MinHash()) -> DataFrame:
    """Component of every document under "100 * |A ∩ B| >= percent * |A ∪ B|".

    Returns ``id_col, n_shingles, component_id, kept``, one row per input row; other input
    columns are ignored, so their names cannot clash. Defined cases: a null or empty text
    has no shingles, links with nothing and is kept; a text shorter than a shingle is one
    shingle; equal texts link, the smallest id stays; a row with a null id is kept, in the
    component of equal texts (else null); rows that share an id are one node with the links of each; an empty
    table gives an empty result. Texts are read whole, whatever their length.
    """
    p, spark = params, docs.sparkSession
    tune(spark)
    sigs = written(signatures(docs, id_col, text_col, p), "minhash-sig")
    reps = (sigs.where("id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("rep")))
    reps = written(reps, "minhash-rep")
    # an id with several texts is one node: it is linked with the representative of each
    several = sigs.where("id is not null").groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y"), F.count("digest").alias("c"), F.count("*").alias("n"))
    several = several.where("x <> y or (c > 0 and c < n)").select("id")
    shared = sigs.select("id", "digest").join(several, "id", "left_semi").join(reps, "digest").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    shared = written(shared, "minhash-shared")
    chosen = sigs.join(reps.select(F.col("rep").alias("id"), "digest"), ["id", "digest"])
    members = bucket_members(chosen.select("id", "keys"), p)
    members = (members.join(chosen.select("id", "sig").dropDuplicates(["id", "sig"]), "id")
               .select("key", "size", "id", "sig"))
    members = written(members, "minhash-members")

    first = written(candidate_pairs(members.withColumn("comp", F.lit(-1).cast("bigint")), p, _forest), "minhash-pairs")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = members.select("id").distinct()
    # candidates grow with the corpus: shuffled at every size, never broadcast
    texts = written(texts.join(ids.hint("merge"), "id", "left_semi"), "minhash-texts")
    links = written(confirmed(first, texts, p), "minhash-links")
    links = links.unionByName(shared)
    comp = written(components(links), "minhash-comp")

    # second wave: buckets that still span several components
    label = comp.select(F.col("node").alias("id"), F.col("component").alias("c"))
    labelled = members.join(label, "id", "left").withColumn("comp", F.xxhash64(F.coalesce("c", "id"))).drop("c")
    split = (labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key"))
    crossed = labelled.join(split, "key", "left_semi").join(chosen.select("id", "sig", "keys").dropDuplicates(["id", "sig"]), ["id", "sig"])
    second = candidate_pairs(crossed.select("key", "size", "id", "sig", "comp", "keys"), p, _cross).join(first, ["a", "b"], "left_anti")
    more = written(confirmed(second, texts, p), "minhash-links")
    if not more.isEmpty():
        stars = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
        comp = components(stars.unionByName(more))

    found = reps.join(comp, reps["rep"] == comp["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sigs.select("id", "n_shingles", "digest").join(found, "digest", "left")
    # an empty text is in the component of the other texts of its id
    empty = shared.join(comp, shared["a"] == comp["node"]).select(F.col("a").alias("id"), F.col("component").alias("of_id")).distinct()
    out = out.join(empty.hint("merge"), "id", "left").select("id", "n_shingles", F.coalesce("component", "of_id", "id").alias("component"))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"),
                      (F.col("id").isNull() | (F.col("component") == F.col("id"))).alias("kept"))
