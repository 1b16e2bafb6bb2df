"""Language identification by prediction by partial matching (PPM).

Per language a byte context tree of depth 3 holds the counts of each next byte. With frozen
counts the code length of a byte is exact: a byte seen after the context costs
-log2(n / (N + d)), else the escape costs -log2(d / (N + d)) and the next shorter context is
asked (method C; N occurrences and d distinct bytes after the context), down to 8 bits a byte.
A text (after lower-casing A-Z) starts in the context of three line breaks. The language with
the shortest total code wins; `score` is its posterior at equal priors, from code lengths a
byte times `sharpness`.

Training counts all 4-byte windows of all training rows: distinct windows a task are added up
before the shuffle. Every window counted is scored with. Up to `capacity` windows (of all
languages) make one model; more are cut into blocks by the two bytes before the last, so that
the contexts of depth 3 and 2 are whole in their block (at most 2**16 windows a language have
the same two bytes). A block knows the counts of depth 1 and 0 of all windows (at most 2**16 a
language). A worker goes through all blocks for each few megabytes of text, adding the code
lengths of the bytes whose windows lie in the block; it and the driver hold one block at a time.

Null texts and texts without a letter are `und` with score 0. Rows without a language are not
learned from. Without any training row everything is `und`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, byte_tables, flat, pieces, send, stored, unused

DEPTH = 3
CAPACITY = 1 << 20
PLACES = 1 << 16
SLICES = 32
FOLDS, LEAST_ROWS, SPREADS, ALLOWANCE = 8, 30, 12, 64
_BITS = 20
_MULT = np.uint32(0x9E3779B1)


def windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte and the three before it as one uint32, for each byte of each text."""
    low = byte_tables()[0][data]
    n = np.diff(offsets)
    padded = np.full(len(low) + DEPTH * len(n), 10, np.uint8)
    at = np.arange(len(low)) + np.repeat(DEPTH * np.arange(1, len(n) + 1), n)
    padded[at] = low
    w = padded.astype(np.uint32)
    out = (w[:-3] << np.uint32(24)) | (w[1:-2] << np.uint32(16)) | (w[2:-1] << np.uint32(8)) | w[3:]
    return out[at - DEPTH] if len(at) else np.empty(0, np.uint32)


def count_windows(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (text, lang); a task adds up its rows before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            g, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return g, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)

        for b in batches:
            for lang in b.column(1).unique().to_pylist():
                parts = held.setdefault(lang, [])
                for part in pieces(b.filter(pa.compute.equal(b.column(1), lang)), "text", 1 << 19):
                    parts.append(np.unique(windows(*flat(part.column(0))), return_counts=True))
                if sum(len(g) for g, _ in parts) > 1 << 20:
                    held[lang] = [added(parts)]
        for lang, parts in ((x, y) for x, y in held.items() if y):
            g, n = added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return arrow_map(train, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Code lengths of windows, hashed, from the counts of each language.

    With a `span` the counts are those of the windows with these two bytes before the last (from, to), and only such
    bytes of a text are charged; `low` then has the counts of the last two bytes of all windows.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], span: tuple[int, int] | None = None, low: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
        self.langs, self.span = sorted(counts), span
        self.trees = []
        for lang in self.langs:
            levels = []
            for k in range(DEPTH, -1, -1):  # context length k: symbol windows and their contexts
                g, n = (low if low is not None and k < 2 else counts)[lang]
                g, n = g.astype(np.uint32), n.astype(np.float64)
                mask = np.uint32(0xFFFFFFFF if k == 3 else (1 << 8 * (k + 1)) - 1)
                key, back = np.unique(g & mask, return_inverse=True)
                own = np.bincount(back, n, len(key))
                ctx, cback = np.unique(key >> np.uint32(8), return_inverse=True)
                levels.append((key, own, ctx, np.bincount(cback, own, len(ctx)), np.bincount(cback, minlength=len(ctx)).astype(np.float64)))
            self.trees.append(levels)
        every = np.unique(np.concatenate([counts[x][0] for x in self.langs]).astype(np.uint32)) if self.langs else np.empty(0, np.uint32)
        self.slot = np.zeros(1 << _BITS, np.uint32)
        self.taken = np.zeros(1 << _BITS, bool)
        at = self._place(every)
        self.slot[at], self.taken[at] = every, True  # of windows that meet in a slot the last stays; the others are computed
        self.cost = np.zeros((len(self.langs), 1 << _BITS), np.float32)
        for i in range(len(self.langs)):
            self.cost[i, self.taken] = self._bits(i, self.slot[self.taken])

    @staticmethod
    def _place(w: np.ndarray) -> np.ndarray:
        return ((w ^ (w >> np.uint32(15))) * _MULT >> np.uint32(32 - _BITS)).astype(np.int64)

    def _bits(self, i: int, w: np.ndarray) -> np.ndarray:
        """Exact code length in bits of each window's last byte under language i."""
        out = np.zeros(len(w))
        todo = np.arange(len(w))
        for k, (key, own, ctx, total, kinds) in zip(range(DEPTH, -1, -1), self.trees[i]):
            if not len(key):
                continue
            mask = np.uint32(0xFFFFFFFF if k == 3 else (1 << 8 * (k + 1)) - 1)
            x = w[todo] & mask
            c = np.minimum(np.searchsorted(ctx, x >> np.uint32(8)), len(ctx) - 1)
            known = ctx[c] == x >> np.uint32(8)
            s = np.minimum(np.searchsorted(key, x), len(key) - 1)
            hit = key[s] == x
            out[todo[hit]] += np.log2((total[c[hit]] + kinds[c[hit]]) / own[s[hit]])
            miss = known & ~hit
            out[todo[miss]] += np.log2((total[c[miss]] + kinds[c[miss]]) / kinds[c[miss]])
            todo = todo[~hit]
        out[todo] += 8.0
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Total code length in bits, a row a language, a column a text."""
        w = windows(data, offsets)
        at = self._place(w)
        hit = self.taken[at] & (self.slot[at] == w)
        if self.span:
            place = (w >> np.uint32(8)) & np.uint32(PLACES - 1)
            own = (place >= self.span[0]) & (place < self.span[1])
        rare = np.flatnonzero(~hit & own if self.span else ~hit)
        kinds, back = np.unique(w[rare], return_inverse=True)
        out = np.zeros((len(self.langs), len(offsets) - 1))
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return out
        for i in range(len(self.langs)):
            bits = self.cost[i][at].astype(np.float64)
            bits[rare] = self._bits(i, kinds)[back]
            if self.span:
                bits[~own] = 0
            out[i, full] = np.add.reduceat(bits, offsets[full])  # a text's own sum, whatever its batch
        return out


class Trained:
    """All windows counted, as a table (lang, gram, n), and the spans of places (the two bytes before the last) that make a block each."""

    def __init__(self, counts: DataFrame, capacity: int):
        self.counts = counts
        self.place = F.shiftright("gram", 8).bitwiseAND(F.lit(PLACES - 1))
        sizes = counts.groupBy(self.place.alias("place")).agg(F.count(F.lit(1)).alias("kinds")).toArrow()  # at most PLACES rows
        kinds = np.bincount(sizes.column("place").to_numpy(), sizes.column("kinds").to_numpy(), PLACES)
        self.empty = not kinds.any()
        starts, total = [0], 0
        for place in np.flatnonzero(kinds):
            if total and total + kinds[place] > capacity:
                starts.append(int(place))
                total = 0
            total += kinds[place]
        self.spans = list(zip(starts, [*starts[1:], PLACES]))
        self.low = None
        if len(self.spans) > 1:
            last = F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")
            self.low = self._arrays(counts.groupBy("lang", last).agg(F.sum("n").alias("n")))  # at most 2**16 rows a language

    @staticmethod
    def _arrays(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        table = counts.toArrow()
        out = {}
        for lang in sorted(table.column("lang").unique().to_pylist()):
            own = table.filter(pa.compute.equal(table.column("lang"), lang))
            out[lang] = (own.column("gram").to_numpy(), own.column("n").to_numpy())
        return out

    def block(self, k: int) -> Model:
        if self.low is None:
            return Model(self._arrays(self.counts))
        span = self.spans[k]
        found = self._arrays(self.counts.filter((self.place >= span[0]) & (self.place < span[1])))
        none = np.empty(0, np.int64)
        return Model({lang: found.get(lang, (none, none)) for lang in self.low}, span, self.low)


def fit(train: DataFrame, capacity: int = CAPACITY) -> Trained:
    """All windows of (text, lang) rows with a language; `capacity` bounds the windows held at once, not those kept."""
    return Trained(stored(count_windows(train), "windows"), capacity)


def predict(docs: DataFrame, model: Trained, text_col: str = "text", sharpness: float = 20.0, out: tuple[str, str, str] = ("lang_pred", "score", "bits")) -> DataFrame:
    """All columns of docs, as they are, plus the prediction, its score and its code length in bits a byte, under the names `out` (with underscores added if docs has a column of that name)."""
    spark, names = docs.sparkSession, docs.columns
    out = tuple(unused(x, names) for x in out)
    kinds = ("string", "double", "double")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(out, kinds)]])
    mark = unused("letters", [*names, *out])
    letters = F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False))
    place = names.index(text_col)
    sent = [send(spark, model.block(k), keep=len(model.spans) == 1) for k in range(len(model.spans))]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
        """Slices of the batches, the languages, and the total code lengths: a row a language, a column a text."""
        slices = (b for whole in batches if whole.num_rows for b in pieces(whole, text_col, 1 << 19))
        if len(sent) == 1:
            m = sent[0]()
            for b in slices:
                yield b, m.langs, m.lengths(*flat(b.column(place)))
            return
        while some := list(itertools.islice(slices, SLICES)):
            total = [0.0] * len(some)
            for block in sent:  # one at a time in memory
                m = block()
                total = [x + m.lengths(*flat(b.column(place))) for x, b in zip(total, some)]
                langs = m.langs
                del m
            yield from ((b, langs, x) for b, x in zip(some, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, langs, total in measured(batches):
            ok = b.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            n = b.num_rows
            lang, score, bits = np.array(["und"] * n, object), np.zeros(n), np.zeros(n)
            if langs:
                rate = total / np.maximum(pa.compute.binary_length(b.column(place)).fill_null(0).to_numpy(zero_copy_only=False), 1)
                best = rate.argmin(axis=0)
                low = rate.min(axis=0)
                post = 1 / np.exp2(-sharpness * (rate - low)).sum(axis=0)
                lang[ok] = np.array(langs, object)[best[ok]]
                score[ok], bits[ok] = post[ok], low[ok]
            cols = [b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], names=[*names, *out])

    return arrow_map(docs.withColumn(mark, letters), run, schema)


def bounds(train: DataFrame, capacity: int = CAPACITY) -> dict[str, float]:
    """The most bits a byte a text of a language may cost, from rows of (text, lang) that the model measuring them was not taught; none for a language with too few of these."""
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    found = predict(train.filter(fold), fit(train.filter(~fold), capacity))
    fair = found.filter((F.col("lang_pred") == F.col("lang")) & (F.octet_length("text") >= ALLOWANCE))
    rows = fair.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("bits").alias("mean"), F.stddev_pop("bits").alias("spread")).collect()
    return {r.lang: r.mean + SPREADS * r.spread for r in rows if r.n >= LEAST_ROWS}


def identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs with a letter whose text is not far from the language it is given, with all their columns.

    The model learns from the rows that name a language. A text goes if its code is longer than the bound of its language
    a byte, and ALLOWANCE bits. Without a bound, or any row to learn from, only texts without a letter go.
    """
    text = F.col(f"`{text_col}`").cast("string")
    train = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(train, capacity)
    if model.empty:
        return docs.filter(text.rlike(r"\p{L}"))
    limits = bounds(train, capacity)
    found = predict(docs, model, text_col)
    added = found.columns[len(docs.columns) :]
    lang, bits, size = F.col(added[0]), F.col(added[2]), F.octet_length(text)
    keep = lang != "und"
    for name, most in limits.items():
        keep &= (lang != name) | (bits * size <= most * size + ALLOWANCE)
    return found.filter(keep).drop(*added)
