"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct shingles of five words (words [^\\x20\\x09-\\x0D]+ after
lower-casing A-Z; with fewer words the whole sequence is one shingle), as 64-bit hashes.

1. Signatures: under each of 176 permutations both the minimum and the maximum of the set are
   kept, so 352 values cost 176 hash evaluations a shingle. They are cut into 44 bands; the
   rows a band are the most for which a large pair at the threshold misses all bands with a
   probability of at most 2e-6. Minimum and maximum of a small set agree together less often,
   as they are drawn without replacement; sets small enough to miss that bound get 44 more
   bands of fewer rows, which keep it (`small_bands`).
2. Documents with equal sets form a class, with one representative.
3. Representatives that share a band key are tied to the smallest id under that key; connected
   ties are a candidate cluster (no pair list is made, whatever the size of a bucket).
4. Only clustered documents send their full set, and full sets are compared exactly. A cluster
   is dealt into blocks of bounded size, each with the cluster's pivot (its smallest node); a task
   compares the sets of a block and returns a spanning forest of the links, never all pairs. Most
   clusters are one block and done. Larger ones fall into groups linked so far; pairs inside a
   group need no comparison any more, so if a cluster has more than one group, the blocks of all
   but its largest group meet each other and those of the largest. Every pair of a cluster is thus
   compared or known to be connected; near copies of one document cost one block each.
5. Components of the forests, carried back through the classes.

Null and empty texts have no set: they link with nothing. A node is a set with its smallest id,
so rows that share an id but differ in text are grouped each by its own text. Repeated rows are
each returned. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, flat, mix, pieces, send, shingles, stored, unused, words
from .components import components

PERMUTATIONS, BANDS, MISS = 176, 44, 2e-6
BLOCK_DOCS, BLOCK_SHINGLES = 256, 500_000
HOT_SHARE = 2000
UNIONS = 10_000
BLOOM_BITS = 1 << 27


def rows_a_band(threshold: float) -> int:
    """The most rows a band (up to 8) at which a pair at the threshold is missed with probability MISS at most."""
    return max(r for r in range(1, 9) if r == 1 or (1 - threshold**r) ** BANDS <= MISS)


def missed(percent: int, rows: int, union: np.ndarray) -> np.ndarray:
    """The probability that two sets at the threshold, with so many shingles in their union, share no band."""
    shared = -(-percent * union // 100)
    one = shared / union
    both = one * np.where(union > 1, (shared - 1) / np.maximum(union - 1, 1), 1)
    return (1 - both ** (rows // 2) * one ** (rows % 2)) ** BANDS


def small_bands(percent: int) -> tuple[int, int]:
    """(size, rows): sets of at most `size` shingles need bands of `rows` as well (size 0: no set does)."""
    union = np.arange(1, UNIONS + 1)
    over = union[missed(percent, rows_a_band(percent / 100), union) > MISS]
    if not len(over):
        return 0, 0
    fair = [r for r in range(1, rows_a_band(percent / 100)) if (missed(percent, r, union[: over[-1]]) <= MISS).all()]
    return int(over[-1]), max(fair, default=1)


def min_max(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation for each run of values: one row a set, 2 * PERMUTATIONS columns."""
    rng = np.random.default_rng(77)
    flip = rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
    mult = rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), 2 * PERMUTATIONS), np.uint32)
    h = np.empty_like(x)
    for k in range(PERMUTATIONS):
        np.bitwise_xor(x, flip[k], out=h)
        np.multiply(h, mult[k], out=h)
        out[:, 2 * k] = np.minimum.reduceat(h, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(h, starts)
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key a band: BANDS * rows values, min and max of a permutation side by side."""
    used = signatures[:, : BANDS * rows].reshape(len(signatures), BANDS, rows).astype(np.uint64)
    weights = np.random.default_rng(78).integers(0, 2**62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.zeros((len(signatures), BANDS), np.uint64)
    for i in range(rows):
        keys += mix(used[:, :, i] + np.uint64(i + 1)) * weights[i]
    return mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sets_of(batch_column: pa.Array) -> list[np.ndarray]:
    h, _, _, at = words(*flat(batch_column))
    s, offsets = shingles(h, at)
    return [np.unique(s[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]


def print_of(shingles_: np.ndarray) -> bytes | None:
    """128 bits of a set, null for an empty one."""
    return hashlib.blake2b(shingles_.tobytes(), digest_size=16).digest() if len(shingles_) else None


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, key, n_shingles, print, bands) of (doc_id, text, key); print (128 bits of the set) and bands are null for an empty set."""
    rows, (size, fewer) = rows_a_band(percent / 100), small_bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text") if whole.num_rows else []:
                sets = sets_of(b.column(1))
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                prints = [print_of(s) for s in sets]
                bands = [None] * len(sets)
                if len(full):
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    values = min_max(np.concatenate([sets[i] for i in full]), starts)
                    for i, row in zip(full, band_keys(values, rows).view(np.int64)):
                        bands[i] = row
                    small = n[full] <= size
                    if small.any():
                        for i, row in zip(full[small], band_keys(values[small], fewer).view(np.int64)):
                            bands[i] = np.concatenate([bands[i], row])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "n_shingles", "print", "bands"])

    return arrow_map(docs, run, "doc_id long, key string, n_shingles long, print binary, bands array<long>")


def clusters(reps: DataFrame) -> DataFrame:
    """(id, component) of the candidate clusters among (node, bands): ties to the smallest node under each band key."""
    entries = reps.select("node", F.explode("bands").alias("key"))
    pivots = entries.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").drop("last")
    return components(entries.join(pivots, "key").filter("node <> pivot").select("node", "pivot"), "node", "pivot")


def bloom(ids: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bits of a Bloom filter over `id` with 16 bits an entry, at most BLOOM_BITS in all (more entries: more false hits)."""
    bits = min(BLOOM_BITS, 1 << max(16, (16 * max(n, 1) - 1).bit_length()))
    h = F.xxhash64("id")
    at = F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))))
    set_bits = ids.select(at.alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, CAST(bit & 63 AS INT))").alias("m"))
    found = set_bits.groupBy("word").agg(F.bit_or("m").alias("m")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("m").to_numpy()
    return out.view(np.uint64), bits


def sets_for(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, print, shingles binary) for documents whose id the Bloom filter over `ids` lets through."""
    words_of, bits = bloom(ids, n)
    sent = send(docs.sparkSession, words_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent()
        for whole in batches:
            h = whole.column(2).to_numpy().view(np.uint64)
            keep = np.ones(len(h), bool)
            for at in (h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)):
                keep &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            whole = whole.filter(pa.array(keep))
            for b in pieces(whole, "text") if whole.num_rows else []:
                sets = sets_of(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([print_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "print", "shingles"])

    return arrow_map(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).filter("doc_id IS NOT NULL"), run, "doc_id long, print binary, shingles binary")


def links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (id, root) of the pairs with 100 * |A and B| >= percent * |A or B|."""
    n = np.array([len(s) for s in sets], np.int64)
    d = len(sets)
    every, owner = np.concatenate(sets), np.repeat(np.arange(d), n)
    _, back, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[back] > 1
    column = np.cumsum(count > 1)[back[shared]] - 1
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((d, d), np.float32)
    width = max(256, (1 << 21) // d)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + width + 1, width))
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
        if j > i:
            m = np.zeros((d, width), np.float32)
            m[owner[i:j], column[i:j] - k * width] = 1
            both += m @ m.T  # exact: counts stay under 2**24
    either = n[:, None] + n[None, :] - both
    near = (100 * both.astype(np.float64) >= percent * either.astype(np.float64)) & (n[:, None] > 0) & (n[None, :] > 0)
    np.fill_diagonal(near, True)
    root = np.arange(d)
    while True:
        new = np.where(near, root[None, :], d).min(axis=1)
        new = np.minimum(new, root)
        if (new == root).all():
            break
        root = new
    linked = root != np.arange(d)
    return ids[linked], ids[root[linked]]


def compared(sets: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) among the (id, shingles) of each group."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        _, first = np.unique(ids, return_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").take(pa.array(first)).to_pylist()]
        a, b = links(ids[first], sets, percent) if len(first) > 1 else (ids[:0], ids[:0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sets.select("id", "shingles", *keys).groupBy(*keys).applyInArrow(run, "a long, b long")


def _small(facts: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """Facts of large clusters, broadcast while they are few, so that a cluster's documents do not meet in one task."""
    return F.broadcast(facts) if facts.count() <= broadcast_rows else facts


def verified(docs: DataFrame, found: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked in the candidate clusters `found` (id, component) of the nodes of `reps`, compared on full sets."""
    found = found.join(reps.select(F.col("node").alias("id"), "rep", "print", "n_shingles"), "id")
    facts = found.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    many = stored(facts.select("component", blocks.alias("blocks")).filter("blocks > 1"), "large")
    nodes = stored(found.join(_small(many), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "nodes")
    sets = lambda of: sets_for(docs, of.select(F.col("rep").alias("id")), of.count()).join(of.withColumnRenamed("rep", "doc_id"), ["doc_id", "print"])
    pivot = F.col("id") == F.col("component")
    dealt = sets(nodes).withColumn("i", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block(F.col("blocks"), 5)))))
    large = nodes.filter("blocks > 1")
    if large.isEmpty():
        return compared(dealt, ["component", "i"], percent)
    first = stored(compared(dealt, ["component", "i"], percent), "block-links")
    known = components(first).withColumnRenamed("component", "part")
    parts = large.drop("blocks").join(known, "id", "left").withColumn("part", F.coalesce("part", "id"))
    sizes = parts.groupBy("component", "part").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("total"))
    best = sizes.groupBy("component").agg(F.max_by("part", F.struct("docs", -F.col("part"))).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    sides = sizes.join(best, "component").groupBy("component", "main").agg(*[
        F.greatest(F.ceil(F.sum(F.when(side, F.col("docs"))) / BLOCK_DOCS), F.ceil(F.sum(F.when(side, F.col("total"))) / BLOCK_SHINGLES)).cast("int").alias(name)
        for name, side in (("main_blocks", F.col("part") == F.col("main")), ("other_blocks", F.col("part") != F.col("main")))
    ])
    again = stored(parts.join(_small(stored(sides, "sides")), "component"), "unconnected")
    if again.isEmpty():
        return first
    is_main = F.col("part") == F.col("main")
    own = F.when(is_main, block(F.col("main_blocks"), 6)).otherwise(block(F.col("other_blocks"), 7))
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda i, j, with_main: F.struct(i.alias("i"), j.alias("j"), F.lit(with_main).alias("with_main"))
    to_main = F.transform(numbers("main_blocks"), lambda j: pair(F.col("own"), j, True))
    to_others = F.transform(numbers("other_blocks"), lambda j: pair(F.least(F.col("own"), j), F.greatest(F.col("own"), j), False))
    from_main = F.transform(numbers("other_blocks"), lambda i: pair(i, F.col("own"), True))
    meet = sets(again).withColumn("own", own).withColumn("at", F.explode(F.when(is_main, from_main).otherwise(F.concat(to_main, to_others))))
    return first.unionByName(compared(meet.select("id", "shingles", "component", "at.*"), ["component", "with_main", "i", "j"], percent))


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """One row a document of (doc_id, text, key): doc_id, key, n_shingles, component_id, kept."""
    signed = stored(signatures(docs, percent).withColumn("rid", F.monotonically_increasing_id()), "signatures")  # the number is fixed once stored
    classes = signed.filter("print IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.max("n_shingles").alias("n_shingles"), F.min("rid").alias("node"))
    classes = stored(classes, "classes")
    reps = classes.filter("rep IS NOT NULL")
    # any row of a class has its bands: those of the row that gave the node its number
    bands = signed.filter("print IS NOT NULL").select(F.col("rid").alias("node"), "bands").join(reps.select("node").hint("merge"), "node")
    found = stored(clusters(bands), "clusters")
    linked = components(verified(docs, found, reps, percent)).withColumnRenamed("id", "node").join(reps.select("node", "rep"), "node")
    linked = stored(linked, "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select("node", "least")
    known = classes.select("print", "rep", "size", "node").join(linked, "node", "left").withColumn("to", F.coalesce("least", "rep")).filter("size > 1 OR to <> rep").select("print", "to", "size")
    known = stored(known, "known")
    rows = signed.select("doc_id", "key", "n_shingles", "print")
    limit = max(100, rows.count() // HOT_SHARE)
    hot = F.broadcast(known.filter(F.col("size") > limit))  # fewer than HOT_SHARE classes
    some = rows.join(hot, "print")
    rest = rows.join(hot.select("print"), "print", "left_anti").join(known.filter(F.col("size") <= limit).hint("merge"), "print", "left")
    end = F.coalesce("to", "doc_id")
    return some.unionByName(rest).select("doc_id", "key", "n_shingles", end.alias("component_id"), F.col("doc_id").eqNullSafe(end).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept (the smallest id of each component)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit("").alias("key"))
    return grouped(docs, percent).drop("key")


def distinct_documents(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs whose id is the smallest of their text's near-duplicate group, with all their columns."""
    name, text = unused("gone_id", docs.columns), unused("gone_text", docs.columns)
    key = F.md5(docs[text_col].cast("string").cast("binary"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), key.alias("key"))
    gone = stored(grouped(rows, percent).filter("NOT kept").select(F.col("doc_id").alias(name), F.col("key").alias(text)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone.hint("merge")
    return docs.join(gone, (docs[id_col].cast("long") == gone[name]) & (key == gone[text]), "left_anti")
