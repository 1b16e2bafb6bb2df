"""Exact deduplication against a history of digests held under a minimal perfect hash.

Every text is reduced to the SHA-256 of its UTF-8 bytes after lower-casing A-Z (in Arrow
batches: Spark's translate() walks code points and costs three times the CPU). Distinct
digests seen earlier (the history) are dealt into shards by their first bytes; a task builds
a minimal perfect hash over its shard, whose slots hold the full digest, the locator (id) of
the winning row and the number of copies. New digests, already one a text by map-side
aggregation, are looked up and compared byte by byte: members raise their slot's winner and
count, the others form groups of their own. The result is the next history.

Nulls and empty texts are the same (empty) text. A null id never wins against another id.
Rows that repeat both id and text share one verdict. A history may name a digest more than once
(two batches put together): its rows count as one, with the largest id and the sum of the sizes.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, arrow_map, flat, mix, stored, unused

REGISTRY = "digest binary, keep_id long, group_size long"
HOT_SHARE = 2000
"""A digest with more than 1/HOT_SHARE of all rows is hot; so at most HOT_SHARE digests are broadcast."""


def raw_key(text: Column) -> Column:
    """128 bits of a text as it is, the empty one for null: with the id it names a row where the row's digest is not at hand."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, digest) for every row, with `raw_key` as key if asked for; null text counts as empty."""
    names = ["doc_id", *(["key"] if keyed else []), "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(pa.compute.ascii_lower(b.column(b.num_columns - 1)))
            raw = memoryview(data)
            out = [hashlib.sha256(raw[i:j]).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *([raw_key(F.col(text_col)).alias("key")] if keyed else []), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, " + ("key string, " if keyed else "") + "digest binary")


def registry(rows: DataFrame) -> DataFrame:
    """One row a distinct digest: the largest id and the number of rows (partial aggregation before the shuffle)."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


class PerfectHash:
    """A minimal perfect hash over distinct 128-bit keys: levels of bit arrays, the rank of a key's bit is its slot."""

    LEVELS = 100

    def __init__(self, keys: np.ndarray, gamma: float = 1.6):
        self.size, self.levels = len(keys), []
        base = 0
        left = keys
        while len(left):
            if len(self.levels) == self.LEVELS:  # even two keys part within a few levels
                raise ValueError("keys of a perfect hash must be distinct")
            m = max(64, int(gamma * len(left)))
            at = self._place(left, len(self.levels), m)
            once = np.bincount(at, minlength=m) == 1
            self.levels.append((m, once, np.cumsum(once) - 1 + base))
            base += int(once.sum())
            left = left[~once[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix(keys[:, 0] + np.uint64(level + 1) * (keys[:, 1] | np.uint64(1))) % np.uint64(m)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level claims it; a non-member may get any slot."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (m, once, rank) in enumerate(self.levels):
            at = self._place(keys[todo], level, m)
            hit = once[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        return out


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digests with the largest id (a null is the smallest) and the sum of the sizes of each."""
    raw = flat(t.column("digest"))[0].reshape(-1, 32)
    ids = t.column("keep_id").combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    size = t.column("group_size").to_numpy()
    if not len(raw):
        return raw, ids, size
    _, first, back = np.unique(np.ascontiguousarray(raw).view("V32").ravel(), return_index=True, return_inverse=True)
    winner, total = ids[first], np.zeros(len(first), np.int64)
    np.maximum.at(winner, back, ids)
    np.add.at(total, back, size)
    return raw[first], winner, total


def _merge_shard(old: pa.Table, new: pa.Table) -> pa.Table:
    slot_digest, winner, size = (x.copy() for x in _columns(old))
    raw, ids, counts = _columns(new)
    key = lambda d: np.ascontiguousarray(d[:, :16]).view(np.uint64).reshape(-1, 2)
    table = PerfectHash(key(slot_digest))
    order = table.slots(key(slot_digest))
    slot_digest[order], winner[order], size[order] = slot_digest.copy(), winner.copy(), size.copy()
    at = table.slots(key(raw))
    member = at >= 0
    if len(slot_digest):
        member[member] = (slot_digest[at[member]] == raw[member]).all(axis=1)
    np.maximum.at(winner, at[member], ids[member])
    np.add.at(size, at[member], counts[member])
    digest = np.concatenate([slot_digest, raw[~member]])
    keep = np.concatenate([winner, ids[~member]])
    return pa.table({
        "digest": pa.array([x.tobytes() for x in digest], pa.binary()),
        "keep_id": pa.array(keep, pa.int64(), mask=keep == np.iinfo(np.int64).min),
        "group_size": pa.array(np.concatenate([size, counts[~member]]), pa.int64()),
    })


def merge(history: DataFrame, fresh: DataFrame, rows: int, per_shard: int = 100_000) -> DataFrame:
    """The next history: `fresh` (one row a digest) looked up in the perfect hash over `history`, shard by shard."""
    spark = history.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_shard))
    shard = (F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long") % shards).alias("shard")
    old, new = (x.select("digest", "keep_id", "group_size", shard) for x in (history, fresh))
    return old.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(_merge_shard, REGISTRY)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    `history` (digest, keep_id, group_size) holds what earlier batches left; without one, the rows
    with an id up to the middle of the id range count as the earlier batch and the rest as new.
    """
    return judged(stored(digests(docs, id_col, text_col), "digests"), history)


def judged(rows: DataFrame, history: DataFrame | None) -> DataFrame:
    """`exact_dedup` of stored rows (doc_id, digest), with their other columns."""
    facts = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    total = facts[0]
    if history is None:
        middle = ((facts[1] or 0) + (facts[2] or 0)) // 2
        early = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
        history, fresh = registry(rows.filter(early)), registry(rows.filter(~early))
    else:
        fresh = registry(rows)
        total += history.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    known = stored(merge(history, fresh, total), "registry")
    return verdicts(rows, known, total)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the largest id, once even if the row repeats."""
    found = stored(judged(stored(digests(docs, id_col, text_col, keyed=True), "digests"), None), "verdicts")
    key, gone_id, gone_key = (unused(x, docs.columns) for x in ("key", "gone_id", "gone_key"))
    gone = found.filter("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key)).distinct()
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone.hint("merge")
    keyed = docs.withColumn(key, raw_key(F.col(text_col)))
    kept = keyed.join(gone, keyed[id_col].cast("long").eqNullSafe(gone[gone_id]) & (keyed[key] == gone[gone_key]), "left_anti")
    if not found.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():
        same = F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER), 256)
        kept = kept.withColumn(key, same).dropDuplicates([id_col, key])
    return kept.drop(key)


def verdicts(rows: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """Each row's group from the registry; hot digests (few by definition) are broadcast, the others meet by a shuffle."""
    repeated = known.filter("group_size > 1")
    limit = max(100, total // HOT_SHARE)
    hot = F.broadcast(repeated.filter(F.col("group_size") > limit))
    some = rows.join(hot, "digest")
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(repeated.filter(F.col("group_size") <= limit).hint("merge"), "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return some.unionByName(rest).select(
        "doc_id",
        *[c for c in rows.columns if c not in ("doc_id", "digest")],
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
