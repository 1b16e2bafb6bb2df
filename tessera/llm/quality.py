"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes some two dozen numbers (shares of character classes, word and sentence lengths,
repetition of words, shingles and lines). Each feature is cut at quantiles of the training rows.
Boosting goes round the features in turn and adds a shallow tree (three leaves) on the logistic
gradient to that feature's lookup table; then the pairs of features whose coarse joint table
explains most of the remaining gradient get tables of their own, boosted the same way with trees
of two splits. A held-out part of the training rows stops both. Scoring is a sum of table entries.

The model is fitted on a sample of at most about `max_train` labelled rows (by a hash of the
id); a sample's size decides only which labelled rows are learned from. Every document is scored
from its whole text. Null and empty texts have all features 0 and get the score of that point.
Labels that are null, or whose document is missing, are not learned from; without both classes
the score is the label share (0.5 without any label). Repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, flat, once, pieces, send, shingles, unused, words

MAX_TRAIN = 20_000
BINS, COARSE = 48, 8
CLASSES = ["lower", "upper", "digit", "space", "newline", "stop", "comma", "shout", "pipe", "symbol", "bracket", "quote", "dash", "control", "lead", "follow"]
FEATURES = ["log_bytes", *CLASSES[:-1], "log_words", "word_length", "long_words", "short_words", "upper_words", "odd_ends", "distinct_words", "top_word", "distinct_shingles", "repeated_lines", "sentence_words"]


def _classes() -> np.ndarray:
    of = np.full(256, CLASSES.index("control"), np.uint8)
    of[97:123], of[65:91], of[48:58] = 0, 1, 2
    of[[32, 9]], of[10] = 3, 4
    for name, chars in (("stop", "."), ("comma", ",;:"), ("shout", "!?"), ("pipe", "|"), ("symbol", "#$%&*+=@^~\\"), ("bracket", "<>()[]{}"), ("quote", "\"'`"), ("dash", "-_/")):
        of[[ord(c) for c in chars]] = CLASSES.index(name)
    of[192:], of[128:192] = CLASSES.index("lead"), CLASSES.index("follow")
    return of


def _distinct(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes a text and the count of its most frequent one."""
    key = np.sort((text.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    owner = (key[first] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, np.diff(np.concatenate([first, [len(key)]])))
    return np.bincount(owner, minlength=n), most


def features(column: pa.Array) -> np.ndarray:
    """One row a text, one column a feature of FEATURES."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    of = once(("classes",), _classes)
    kinds = of[data]
    shares = np.bincount(owner * 16 + kinds, minlength=16 * n).reshape(n, 16)
    chars = np.maximum(size - shares[:, 15], 1)
    h, start, end, at = words(data, offsets)
    count = np.diff(at)
    whose = np.repeat(np.arange(n), count)
    each = np.maximum(count, 1)
    mean = lambda x: np.bincount(whose, x, n) / each
    length = end - start
    s, so = shingles(h, at)
    runs = np.diff(so)
    distinct, top = _distinct(whose, h, n)
    distinct_s, _ = _distinct(np.repeat(np.arange(n), runs), s, n)
    upper = np.concatenate([[0], np.cumsum(kinds == 1)])
    last = kinds[end - 1] if len(end) else kinds
    # a line's hash: the sum of its words' hashes by place
    breaks = np.cumsum(kinds == 4)
    line_of = breaks[start] + whose if len(start) else whose
    edge = np.concatenate([[True], line_of[1:] != line_of[:-1]]) if len(h) else np.empty(0, bool)
    lines = np.flatnonzero(edge)
    place = np.arange(len(h)) - np.repeat(lines, np.diff(np.concatenate([lines, [len(h)]]))) if len(h) else np.empty(0, np.int64)
    line_hash = np.add.reduceat(h * (2 * place.astype(np.uint64) + np.uint64(1)), lines) if len(lines) else h
    line_n = np.bincount(whose[lines], minlength=n) if len(lines) else np.zeros(n, np.int64)
    line_distinct, _ = _distinct(whose[lines] if len(lines) else whose, line_hash, n)
    columns = [
        np.log1p(size),
        *[shares[:, k] / chars for k in range(15)],
        np.log1p(count),
        mean(length),
        mean(length > 12),
        mean(length <= 3),
        mean((upper[end] - upper[start]) * 2 > length) if len(h) else np.zeros(n),
        mean((last >= 7) & (last <= 11)) if len(h) else np.zeros(n),
        distinct / each,
        top / each,
        distinct_s / np.maximum(runs, 1),
        1 - line_distinct / np.maximum(line_n, 1),
        count / np.maximum(shares[:, 5], 1),
    ]
    return np.column_stack(columns).astype(np.float64)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, l2: float = 1.0, least: float = 5.0) -> np.ndarray:
    """Leaf values by bin of a small regression tree on ordered bins (gradient sums g, hessian sums h)."""
    cuts = [0, len(g)]
    G, H = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    gain_of = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + l2)
    for _ in range(leaves - 1):
        best = (1e-6, None)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = gain_of(a, m) + gain_of(m, b) - gain_of(a, b)
                gain = np.where((H[m] - H[a] >= least * 0.05) & (H[b] - H[m] >= least * 0.05), gain, 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], m[k])
        if best[1] is None:
            break
        cuts = sorted([*cuts, int(best[1])])
    out = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + l2)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """The best cross of one cut on each axis of a joint table: leaf values and gain."""
    G, H = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    a, b = G.shape[0] - 1, G.shape[1] - 1
    i, j = np.arange(1, a)[:, None], np.arange(1, b)[None, :]
    part = lambda X: (X[i, j], X[i, b] - X[i, j], X[a, j] - X[i, j], X[a, b] - X[i, b] - X[a, j] + X[i, j])
    gain = sum(p**2 / (q + l2) for p, q in zip(part(G), part(H)))
    k = np.unravel_index(int(gain.argmax()), gain.shape)
    r, c = k[0] + 1, k[1] + 1
    out = np.empty_like(g)
    for rows in (slice(0, r), slice(r, a)):
        for cols in (slice(0, c), slice(c, b)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + l2)
    return out, float(gain[k] - G[a, b] ** 2 / (H[a, b] + l2))


class Model:
    """Cut points, a table a feature and a table a pair; scores are sums of entries."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.1, pairs: int = 10, patience: int = 40):
        self.base, self.cuts, self.tables, self.pairs = 0.0, [], [], []
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        self.constant = None
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        self.coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, COARSE + 1)[1:-1])) for f in range(x.shape[1])]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        part = np.random.default_rng(5).permutation(len(y))
        hold, fit = part[: len(y) // 6], part[len(y) // 6 :]
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        bins, wide = self._bins(x, self.cuts), self._bins(x, self.coarse)
        f_all = np.full(len(y), self.base)
        loss = lambda: float(np.logaddexp(0, -f_all[hold] * (2 * y[hold] - 1)).mean())

        def grad() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f_all[fit]))
            return y[fit] - p, p * (1 - p)

        def boost(terms: list) -> None:
            """terms: (table, cell of each row, tree). Keeps the tables of the best held-out round."""
            best, since, kept = loss(), 0, [t.copy() for t, _, _ in terms]
            for _ in range(rounds):
                for t, cell, tree in terms:
                    g, h = grad()
                    add = rate * tree(np.bincount(cell[fit], g, t.size).reshape(t.shape), np.bincount(cell[fit], h, t.size).reshape(t.shape))
                    t += add
                    f_all[:] += add.ravel()[cell]
                now, since = loss(), since + 1
                if now < best - 1e-5:
                    best, since, kept = now, 0, [t.copy() for t, _, _ in terms]
                if since >= patience:
                    break
            for (t, cell, _), k in zip(terms, kept):
                f_all[:] += (k - t).ravel()[cell]
                t[:] = k

        boost([(t, b, _tree) for t, b in zip(self.tables, bins) if t.size > 1])
        g, h = grad()
        scored = []
        for a, b in combinations(range(x.shape[1]), 2):
            shape = (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
            if min(shape) > 1:
                cell = wide[a] * shape[1] + wide[b]
                table = lambda v: np.bincount(cell[fit], v, shape[0] * shape[1]).reshape(shape)  # noqa: E731, B023
                scored.append((_tree2(table(g), table(h))[1], a, b, shape))
        terms = []
        for _, a, b, shape in sorted(scored, reverse=True)[:pairs]:
            table = np.zeros(shape)
            self.pairs.append((a, b, table))
            terms.append((table, wide[a] * shape[1] + wide[b], lambda g, h: _tree2(g, h)[0]))
        if terms:
            boost(terms)

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        total = np.full(len(x), self.base)
        for t, b in zip(self.tables, self._bins(x, self.cuts)):
            total += t[b]
        wide = self._bins(x, self.coarse)
        for a, b, t in self.pairs:
            total += t[wide[a], wide[b]]
        return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Learn from labelled documents; `labels` holds the rows that may be learned from."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    n = known.count()
    known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * min(1.0, max_train / max(n, 1))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    used = rows.join(F.broadcast(known), "id").select("y", "text")  # about max_train rows of 12 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text") if whole.num_rows else []:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(features(b.column(1))), pa.list_(pa.float64()))], ["y", "x"])

    table = arrow_map(used, run, "y int, x array<double>").toArrow()
    y = table.column("y").to_numpy().astype(np.float64)
    x = np.array(table.column("x").to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    order = np.lexsort([*x.T, y])  # the same model whatever the order of partitions
    return Model(x[order], y[order])


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of docs plus the score of each whole text, named `out` (with underscores added if docs has such a column)."""
    names = docs.columns
    at = names.index(text_col)
    out = unused(out, names)
    sent = send(docs.sparkSession, model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        for whole in batches:
            for b in pieces(whole, text_col) if whole.num_rows else []:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.score(features(b.column(at))))], names=[*names, out])

    return arrow_map(docs, run, schema)
