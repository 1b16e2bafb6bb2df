"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents long, so the items' sketches are searched inside the documents'
shingle sets. Items are partitioned by the size of their shingle set; in a partition with at
most u shingles an item's sketch is its floor((1 - threshold) * u) + 1 smallest hashes
(bottom-k MinHash). An item of which a share `threshold` is in a document can miss at most
floor((1 - threshold) * size) shingles, so at least one of its sketch hashes is in the
document: no such pair is lost. Candidates are verified by exact containment: the item's
distinct shingles found in the whole document over all of them.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; shingles have five words; an item of
fewer words is one shingle of all its words, searched at that width. A text's shingles are made
distinct before they meet the index, items with equal sets are searched as one, and index hits
are expanded a bounded slice at a time, so repeated passages and items cost no more than they hold.

Documents are scanned once and in place, without a shuffle. The index is sent to the workers in
blocks of about `block_shingles` shingles; a worker takes one block after the other for each few
megabytes of text, and holds one at a time.

Null or empty texts contain nothing and are contained nowhere. Equal items are all reported.
Null ids are carried as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, flat, pieces, send, shingles, words

WIDTH = 5
SLICES = 32
"""Slices of text searched in one block before the next block is loaded."""


class Index:
    """Sketch hashes of a block of items (sorted, with their items) and the items' full shingle sets; items with equal sets are one."""

    def __init__(self, sets: list[tuple[int | None, int, np.ndarray]], threshold: float, partitions: int = 8):
        self.threshold = threshold
        kinds: dict[tuple[int, bytes], list[int | None]] = {}
        for i, w, s in sets:
            kinds.setdefault((w, s.tobytes()), []).append(i)
        held = [(w, np.frombuffer(raw, np.uint64)) for w, raw in kinds]
        self.ids = list(kinds.values())
        self.sizes = np.array([len(s) for _, s in held], np.int64)
        order = np.argsort(self.sizes, kind="stable")
        bound = np.zeros(len(held), np.int64)
        for part in np.array_split(order, partitions):  # equal depth; the largest size of a partition sets its sketch length
            if len(part):
                bound[part] = self.sizes[part].max()
        take = np.minimum(np.floor((1 - threshold) * bound + 1e-9).astype(np.int64) + 1, self.sizes)
        self.by_width = {}
        for w in sorted({w for w, _ in held}):
            own = [j for j, (x, _) in enumerate(held) if x == w]
            sketch = np.concatenate([held[j][1][: take[j]] for j in own])  # sets are sorted by hash
            item = np.concatenate([np.full(take[j], j) for j in own])
            full = np.concatenate([held[j][1] for j in own])
            full_item = np.concatenate([np.full(self.sizes[j], j) for j in own])
            a, b = np.argsort(sketch, kind="stable"), np.argsort(full, kind="stable")
            self.by_width[w] = (np.unique(sketch), sketch[a], item[a], np.unique(full), full[b], full_item[b])

    def search(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item class, shared shingles) of the pairs that reach the threshold; hashes and offsets as `words` gives them."""
        out = [np.empty((0, 3), np.int64)]
        for w, (kinds, sketch, sketch_item, full_kinds, full, full_item) in self.by_width.items():
            s, so = shingles(hashes, at, w)
            text = np.repeat(np.arange(len(at) - 1), np.diff(so))
            use = _member(full_kinds, s)
            if (short := np.diff(at) < w).any():  # shorter than the item: its one run has another width
                use &= ~short[text]
            s, text = _distinct(s[use], text[use])  # a shingle counts once a text
            near = _member(kinds, s)
            candidates, _ = _counted(sketch, sketch_item, s[near], text[near], len(self.sizes))
            use = _member(np.unique(candidates // len(self.sizes)).astype(np.uint64), text.astype(np.uint64))
            pairs, n = _counted(full, full_item, s[use], text[use], len(self.sizes))
            found_text, item = np.divmod(pairs, len(self.sizes))
            ok = n >= self.threshold * self.sizes[item] - 1e-9
            out.append(np.column_stack([found_text, item, n])[ok])
        found = np.concatenate(out)
        return found[:, 0], found[:, 1], found[:, 2]


def _member(sorted_kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_kinds):
        return np.zeros(len(x), bool)
    return sorted_kinds[np.minimum(np.searchsorted(sorted_kinds, x), len(sorted_kinds) - 1)] == x


def _distinct(s: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    return s[first], text[first]


HITS = 1 << 20
"""Index hits expanded at once."""


def _counted(keys: np.ndarray, items: np.ndarray, x: np.ndarray, text: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct text * kinds + item over all keys equal to an x, and how many of its x each has."""
    lo = np.searchsorted(keys, x, "left")
    n = np.searchsorted(keys, x, "right") - lo
    ends = np.cumsum(n)
    pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    start = 0
    while start < len(x):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + HITS, "right")))  # one x has at most as many hits as the block has items
        m = n[start:stop]
        place = np.repeat(lo[start:stop] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        some, own = np.unique(np.repeat(text[start:stop], m) * kinds + items[place], return_counts=True)
        pairs, back = np.unique(np.concatenate([pairs, some]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, own]), len(pairs)).astype(np.int64)
        start = stop
    return pairs, counts


def item_sets(items: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int, np.ndarray]]:
    """(id, shingle width, sorted distinct shingle hashes) of items that have words."""
    out = []
    for i, text in items:
        data, offsets = flat(pa.array([text], pa.string()))
        h, _, _, at = words(data, offsets)
        if len(h):
            width = min(WIDTH, len(h))
            out.append((i, width, np.unique(shingles(h, at, width)[0])))
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, threshold: float, block_shingles: int) -> Iterator[Index]:
    """The benchmark, streamed through the driver in bounded blocks."""
    held, total = [], 0
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        for entry in item_sets([(row.i, row.t)]):
            held.append(entry)
            total += len(entry[2])
        if total >= block_shingles:
            yield Index(held, threshold)
            held, total = [], 0
    if held:
        yield Index(held, threshold)


def _searched(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, str, str], threshold: float, block_shingles: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """A function over batches that gives each slice with its hits in every block: (slice, [(index, texts, item classes, shared)])."""
    text_col, item_col, item_text = columns
    sent = [send(docs.sparkSession, index, keep=False) for index in blocks(benchmark, item_col, item_text, threshold, block_shingles)]
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        slices = (b for whole in batches if whole.num_rows for b in pieces(whole, text_col))
        only = sent[0]() if len(sent) == 1 else None
        while some := list(itertools.islice(slices, SLICES if len(sent) > 1 else 1)):
            found: list[list] = [[] for _ in some]
            for block in sent:  # one at a time in memory
                index = only or block()
                for k, b in enumerate(some):
                    h, _, _, at = words(*flat(b.column(place)))
                    t, j, n = index.search(h, at)
                    found[k].append(([index.ids[x] for x in j], index.sizes[j], t, n))
                del index
            yield from zip(some, found)

    return run


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_shingles: int = 1_000_000) -> DataFrame:
    """One row for each item a document contains: doc_id, item_id, n_item_shingles, n_shared, containment."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    searched = _searched(rows, benchmark, ("text", item_col, item_text), threshold, block_shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in searched(batches):
            for ids, sizes, t, n in found:
                many = np.array([len(x) for x in ids], np.int64)
                if len(many):
                    columns = [b.column(0).take(pa.array(np.repeat(t, many))), pa.array([i for x in ids for i in x], pa.int64()), pa.array(np.repeat(sizes, many)), pa.array(np.repeat(n, many))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_item_shingles", "n_shared"])

    hits = arrow_map(rows, run, "doc_id long, item_id long, n_item_shingles long, n_shared long")
    return hits.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item_shingles"), 6))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text_col: str = "text", block_shingles: int = 1_000_000) -> DataFrame:
    """The documents (all their columns) that contain no item; the columns of docs are kept as they are."""
    searched = _searched(docs, benchmark, (text_col, "item_id", "text"), threshold, block_shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in searched(batches):
            keep = np.ones(b.num_rows, bool)
            for _, _, t, _ in found:
                keep[t] = False
            yield b.filter(pa.array(keep))

    return arrow_map(docs, run, docs.schema)
