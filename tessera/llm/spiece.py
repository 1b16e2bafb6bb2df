"""Sampled SentencePiece segmentations, without replacement, and their decoding.

A text is a lattice: a node a byte, an edge a piece. The model's pieces keep to one unit, a run of
spaces and the word after it (`vocabulary` makes sure of it), so the lattice is a chain of unit
lattices; lattices of equal units in a batch are built once (trie walk, backward log sums).
Characters without a piece fall back to the byte pieces. A piece of rank r has the weight
(r + 2) ** -alpha (BPE models store ranks); a byte weighs like the last piece that starts a word.

Sampling is perturbed A* search over the lattice. The search tree's nodes are prefixes; a node's
value is the largest Gumbel-perturbed log probability below it. The root's value is a Gumbel
variate; a child drawn by its probability inherits its parent's value, and the mass of all other
children gets a Gumbel variate truncated at that value. Completing the best open node again and
again gives distinct segmentations in falling order of their perturbed log probabilities, which
is Gumbel top-k without replacement. With kappa, the value of the best node left open, a
segmentation of log probability p has the inclusion score 1 - exp(-exp(p - kappa)); its logarithm
is returned (0 if the text has no further segmentation). All random numbers are hashes of the
row key, so a row gets the same samples in any partition.

Null and empty texts have one segmentation without pieces. Texts with fewer than k segmentations
give all they have. Rows with a null or repeated key are sampled like others. The model's path
is read on the driver only; workers get the pieces (a table of the vocabulary's size).
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, flat, mix, once, pieces, powers, send, unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DIGESTS = "doc_id long, sample int, n_pieces long, ids_sha256 string, text_sha256 string, round_trip boolean, log_prob double, log_inclusion double"
SEGMENTS = "doc_id long, sample int, ids array<int>, round_trip boolean, log_prob double, log_inclusion double"
_SPACE = "▁"


def vocabulary(path: str = MODEL) -> list[tuple[int, bytes, float]]:
    """(id, bytes, rank) of all pieces of the model that text can have; the space mark is a space. Byte pieces have rank -1."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            out.append((i, bytes([int(sp.id_to_piece(i)[3:5], 16)]), -1.0))
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            piece = sp.id_to_piece(i).replace(_SPACE, " ")
            if " " in piece.lstrip(" "):
                raise ValueError(f"piece {i} goes on after a word: units would have to be longer than a run of spaces and a word")
            out.append((i, piece.encode(), -sp.get_score(i)))
    return out


class Trie:
    """Byte trie of the pieces: next state by (state, byte), 0 is dead and 1 the root."""

    def __init__(self, pieces_: list[tuple[int, bytes, float]], alpha: float):
        states: dict[bytes, int] = {b"": 1}
        for _, raw, rank in pieces_:
            if rank >= 0:
                for k in range(1, len(raw) + 1):
                    states.setdefault(raw[:k], len(states) + 1)
        self.next = np.zeros((len(states) + 1, 256), np.uint16 if len(states) < 1 << 16 else np.int32)
        self.piece = np.full(len(states) + 1, -1, np.int32)
        size = max(i for i, _, _ in pieces_) + 1
        self.weight = np.full(size, -np.inf)
        self.byte = np.zeros(256, np.int32)
        raws = [b""] * size
        for prefix, s in states.items():
            if prefix:
                self.next[states[prefix[:-1]], prefix[-1]] = s
        worst = max(rank for _, raw, rank in pieces_ if b" " not in raw[1:])
        for i, raw, rank in pieces_:
            raws[i] = raw
            self.weight[i] = -alpha * np.log((rank if rank >= 0 else worst) + 2)
            if rank >= 0:
                self.piece[states[raw]] = i
            else:
                self.byte[raw[0]] = i
        self.longest = max(map(len, raws))
        self.raw = np.frombuffer(b"".join(raws), np.uint8)
        self.size = np.array([len(x) for x in raws], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then the same for the next."""
    before = np.concatenate([[0], np.cumsum(n)[:-1]])
    return np.repeat(start - before, n) + np.arange(int(n.sum()))


class Lattice:
    """Edges of the lattices of `units` laid end to end in `data` (each is a run of spaces and a word, one of them may be missing)."""

    def __init__(self, trie: Trie, data: np.ndarray, start: np.ndarray):
        n = len(data)
        end = np.append(start[1:], n)
        self.stop = stop = np.repeat(end, end - start)
        tail = (data & 0xC0) == 0x80
        whole = np.ones(n, np.int64)  # bytes of the character that starts here
        whole[data >= 0xC0], whole[data >= 0xE0], whole[data >= 0xF0] = 2, 3, 4
        known, count = tail.copy(), np.zeros(n, np.int64)
        padded = np.append(data, np.full(trie.longest + 1, 32, np.uint8))  # a space ends every piece
        follow = trie.next.ravel()
        pos, state, found = np.arange(n), np.ones(n, np.int32), []
        length = 0
        while len(pos):
            state = follow.take(state.astype(np.int64) * 256 + padded[pos + length])
            length += 1
            alive = np.flatnonzero(state) if length < 2 else np.flatnonzero((state > 0) & (pos + length <= stop[pos]))  # a run of spaces may go on in the next unit
            pos, state = pos[alive], state[alive]
            ident = trie.piece[state]
            hit = np.flatnonzero(ident >= 0)
            at = pos[hit]
            found.append((at, ident[hit], length))
            count[at] += 1
            known[at[whole[at] == length]] = True
        lone = np.flatnonzero(~known)  # characters without a piece: an edge a byte
        lone = _spans(lone, np.minimum(whole[lone], stop[lone] - lone))
        if tail.any():  # and continuation bytes that no character claims
            lead = np.flatnonzero(~tail)
            free = tail.copy()
            free[np.minimum(_spans(lead, whole[lead]), n - 1)] = False
            lone = np.union1d(lone, np.flatnonzero(free))
        found.append((lone, trie.byte[data[lone]], 1))
        count[lone] += 1
        self.first = np.concatenate([[0], np.cumsum(count)])
        edges = int(self.first[-1])
        self.at, self.to, self.id = np.empty(edges, np.int64), np.empty(edges, np.int64), np.empty(edges, np.int32)
        free = self.first[:-1].copy()
        for at, ident, length in found:
            e = free[at]
            self.at[e], self.to[e], self.id[e] = at, at + length, ident
            free[at] += 1
        # backward log sums, all units at once by distance from the unit's end; `beta` of a unit's end is 0
        weight = trie.weight[self.id]
        beta = np.full(n + 1, -np.inf)
        done = self.to == stop[self.at] if edges else np.empty(0, bool)
        nodes = np.flatnonzero(count)
        left = stop[nodes] - nodes
        left = left.astype(np.int16) if len(left) and left.max() < 1 << 15 else left
        by = np.argsort(left, kind="stable")
        nodes, left = nodes[by], left[by]
        cuts = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1], [True]])) if len(nodes) else np.zeros(1, np.int64)
        self.logp = np.empty(edges)
        for i, j in zip(cuts[:-1], cuts[1:]):
            node = nodes[i:j]
            c = count[node]
            e = _spans(self.first[node], c)
            x = weight[e] + np.where(done[e], 0.0, beta[self.to[e]])
            runs = np.concatenate([[0], np.cumsum(c)[:-1]])
            top = np.maximum.reduceat(x, runs)
            total = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, c)), runs))
            beta[node] = total
            self.logp[e] = x - np.repeat(total, c)
        self.p = np.exp(self.logp)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge for each node, by its probability, from a uniform variate; long pieces are tried first."""
        e, low = self.first[node + 1] - 1, self.first[node]
        u = u - self.p[e]
        todo = np.flatnonzero((u >= 0) & (e > low))
        while len(todo):
            at = e[todo] - 1
            e[todo] = at
            rest = u[todo] - self.p[at]
            u[todo] = rest
            todo = todo[(rest >= 0) & (at > low[todo])]
        return e


def _uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Variates in (0, 1) that depend on all parts alone."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = mix((h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x632BE59BD9B4E019))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _truncated(phi: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variate of location phi, truncated at bound."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(phi), -np.inf, phi - np.log(np.exp(np.minimum(phi - bound, 700)) - np.log(u)))


class Sampler:
    """Gumbel top-k over the texts of one batch."""

    def __init__(self, trie: Trie, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int):
        self.trie, self.keys, self.k = trie, keys.view(np.uint64), k
        size = np.diff(offsets)
        self.texts = np.flatnonzero(size)  # the others have one empty segmentation
        d = len(size)
        gap = np.cumsum(size > 0)
        raw = np.full(len(data) + len(self.texts), 32, np.uint8)
        raw[np.arange(len(data)) + np.repeat(gap, size)] = data
        self.raw, self.bounds = raw, np.concatenate([[0], np.cumsum(size + (size > 0))])
        space = raw == 32
        starts = np.flatnonzero(space & ~np.concatenate([[False], space[:-1]]) | np.bincount(self.bounds[self.texts], minlength=len(raw)).astype(bool)) if len(raw) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(raw))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(once(("unit bytes",), lambda: np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64))[raw] * powers(0x9E3779B97F4A7C17, len(raw)))])
        inverse = powers(pow(0x9E3779B97F4A7C17, -1, 1 << 64), len(raw))
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        length = (ends - starts)[where]
        unit_start = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        self.lattice = Lattice(trie, raw[_spans(starts[where], length)], unit_start) if len(where) else None
        self.unit = unit_start[which] if len(where) else np.empty(0, np.int64)  # first node of each occurrence
        self.doc = np.searchsorted(self.bounds, starts, "right") - 1  # empty texts share their bound with the next
        first = np.searchsorted(self.doc, np.arange(d + 1))
        self.first_unit = first
        self.rank = np.arange(len(starts)) - first[self.doc] if len(starts) else starts

    def _walk(self, units: np.ndarray, node: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from `node` to the end of each unit: (edges, offsets by unit)."""
        L = self.lattice
        active, cursor, steps = np.arange(len(units)), node.copy(), []
        stop = L.stop[self.unit[units]]
        count = np.zeros(len(units), np.int64)
        go = cursor < stop
        active = active[go]
        while len(active):
            at = cursor[active]
            u = _uniform(self.keys[self.doc[units[active]]], self.rank[units[active]], at - self.unit[units[active]], sample)
            e = L.draw(at, u)
            steps.append((active, count[active], e))
            count[active] += 1
            cursor[active] = L.to[e]
            active = active[cursor[active] < stop[active]]
        offsets = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(offsets[-1], np.int64)
        for a, c, e in steps:
            out[offsets[a] + c] = e
        return out, offsets

    def run(self) -> list[list[tuple[np.ndarray, float, float]]]:
        """For each text its samples in order: (edges, log probability, log inclusion score)."""
        d = len(self.first_unit) - 1
        out: list[list] = [[] for _ in range(d)]
        for t in np.setdiff1d(np.arange(d), self.texts):
            out[t].append((np.empty(0, np.int64), 0.0, 0.0))
        if not len(self.texts):
            return out
        L = self.lattice
        paths: list[list[dict]] = [[] for _ in range(d)]
        roots = -np.log(-np.log(_uniform(self.keys[self.texts], 1 << 40)))
        todo = {t: (None, 0, value) for t, value in zip(self.texts.tolist(), roots.tolist())}  # parent, branch, value
        for sample in range(self.k):
            heads, new_units, new_nodes = {}, [], []
            chance = _uniform(self.keys[list(todo)], np.array([x[1] for x in todo.values()], np.int64), sample, 1 << 41).tolist() if sample and todo else [0.0] * len(todo)
            for (t, (parent, branch, value)), u in zip(todo.items(), chance):
                lo, hi = self.first_unit[t], self.first_unit[t + 1]
                if parent is None:
                    heads[t] = (np.empty(0, np.int64), np.empty(0, np.int64), [], value, 0)
                    new_units.append(np.arange(lo, hi))
                    new_nodes.append(self.unit[lo:hi])
                    continue
                node = L.at[parent["edges"][branch]]
                banned = [*(parent["banned"] if branch == parent["branch"] else []), int(parent["edges"][branch])]
                free = [e for e in range(L.first[node], L.first[node + 1]) if e not in banned]
                sums = list(itertools.accumulate(L.p[free].tolist()))
                edge = free[min(bisect.bisect_right(sums, u * sums[-1]), len(free) - 1)]
                unit = int(parent["units"][branch])
                heads[t] = (np.append(parent["edges"][:branch], edge), parent["units"][: branch + 1], banned, value, branch)
                new_units.append(np.arange(unit, hi))
                new_nodes.append(np.concatenate([[L.to[edge]], self.unit[unit + 1 : hi]]))
            if not heads:
                break
            units, nodes = np.concatenate(new_units), np.concatenate(new_nodes)
            edges, offsets = self._walk(units, nodes, sample)
            owner = np.repeat(units, np.diff(offsets))
            cut = offsets[np.cumsum([0, *[len(x) for x in new_units]])]
            todo = {}
            parts = []
            for (t, (edge0, unit0, banned, value, branch)), i, j in zip(heads.items(), cut[:-1], cut[1:]):
                path = {"edges": np.append(edge0, edges[i:j]), "units": np.append(unit0, owner[i:j]), "banned": banned, "branch": branch, "value": value}
                paths[t].append(path)
                parts.append((t, path))
            # open nodes along the new paths from their branch on
            size = np.array([len(p["edges"]) for _, p in parts])
            every = np.concatenate([p["edges"] for _, p in parts])
            logp = L.logp[every]
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            prefix = np.concatenate([np.cumsum(logp[x : x + n]) for x, n in zip(start, size)]) - logp  # a path's own sum, whatever its batch
            single = L.first[L.at[every] + 1] - L.first[L.at[every]] == 1
            with np.errstate(divide="ignore"):
                rest = np.where(single, -np.inf, np.log(np.maximum(-np.expm1(logp), 1e-16)))
            for x, (_, p) in zip(start, parts):
                if p["banned"]:
                    e = p["edges"][p["branch"]]
                    gone = {*p["banned"], int(e)}
                    others = [o for o in range(L.first[L.at[e]], L.first[L.at[e] + 1]) if o not in gone]
                    rest[x + p["branch"]] = np.log(L.p[others].sum()) if others else -np.inf
            key = np.repeat(np.array([self.keys[t] for t, _ in parts], np.uint64), size)
            u = _uniform(key, np.arange(len(every)) - np.repeat(start, size), sample, 1 << 42)
            value = np.repeat([p["value"] for _, p in parts], size)
            values = _truncated(prefix + rest, value, u)
            for x, n, (t, p) in zip(start, size, parts):
                p["open"] = values[x : x + n]
                p["open"][: p["branch"]] = -np.inf  # those belong to the parent's path
                p["logp"] = float(logp[x : x + n].sum())
                p["best"] = int(p["open"].argmax())
                found = max(paths[t], key=lambda q: q["open"][q["best"]])
                at = found["best"]
                best = float(found["open"][at])
                if best == -np.inf:
                    continue
                if sample + 1 < self.k:
                    todo[t] = (found, at, best)
                    found["open"][at] = -np.inf
                    found["best"] = int(found["open"].argmax())
        for t in self.texts:
            kappa = max(float(q["open"][q["best"]]) for q in paths[t])
            for q in paths[t]:
                x = q["logp"] - kappa
                out[t].append((q["edges"], q["logp"], 0.0 if x > 30 else (float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x)))
        return out


def decode(trie: Trie, ids: np.ndarray) -> bytes:
    """The text of a sequence of piece ids (the leading space belongs to the encoding)."""
    return trie.raw[_spans(trie.start[ids], trie.size[ids])].tobytes()[1:]


def _sampled(batch: pa.RecordBatch, trie: Trie, k: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, float, float, bytes]]:
    data, offsets = flat(batch.column(1))
    ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    s = Sampler(trie, data, offsets, mix(ids.view(np.uint64) + np.uint64(seed)), k)
    for t, samples in enumerate(s.run()):
        for j, (edges, logp, inclusion) in enumerate(samples):
            yield t, j, s.lattice.id[edges] if len(edges) else np.empty(0, np.int32), logp, inclusion, data[offsets[t] : offsets[t + 1]].tobytes()


def segmentations(docs: DataFrame, k: int = 2, alpha: float = 1.0, seed: int = 7, model_path: str = MODEL, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k distinct sampled segmentations a text: doc_id, sample (0 is the best), ids, round_trip, log_prob, log_inclusion.

    The ids are decoded at once; round_trip tells whether that gave the input. With `digests` the ids are
    replaced by n_pieces, ids_sha256 (32-bit little-endian) and text_sha256 (of the decoded text).
    """
    sent = send(docs.sparkSession, vocabulary(model_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = once(("trie", model_path, alpha), lambda: Trie(sent(), alpha))
        for whole in batches:
            for b in pieces(whole, "text", 1 << 19) if whole.num_rows else []:
                found = list(_sampled(b, trie, k, seed))
                at = pa.array([t for t, *_ in found], pa.int64())
                head = [b.column(0).take(at), pa.array([j for _, j, *_ in found], pa.int32())]
                tail = [pa.array([x[3] for x in found], pa.float64()), pa.array([x[4] for x in found], pa.float64())]
                texts = [decode(trie, x[2]) for x in found]
                same = pa.array([y == x[5] for x, y in zip(found, texts)], pa.bool_())
                if digests:
                    middle = [
                        pa.array([len(x[2]) for x in found], pa.int64()),
                        pa.array([hashlib.sha256(x[2].astype("<i4").tobytes()).hexdigest() for x in found], pa.string()),
                        pa.array([hashlib.sha256(y).hexdigest() for y in texts], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays([*head, *middle, same, *tail], names=["doc_id", "sample", "n_pieces", "ids_sha256", "text_sha256", "round_trip", "log_prob", "log_inclusion"])
                else:
                    yield pa.RecordBatch.from_arrays([*head, pa.array([x[2] for x in found], pa.list_(pa.int32())), same, *tail], names=["doc_id", "sample", "ids", "round_trip", "log_prob", "log_inclusion"])

    return arrow_map(rows, run, DIGESTS if digests else SEGMENTS)


def decoded(rows: DataFrame, model_path: str = MODEL, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """All columns of rows plus the text of each array of piece ids (null ids give a null text; a taken name gets underscores)."""
    sent = send(rows.sparkSession, vocabulary(model_path))
    names = rows.columns
    out = unused(out, names)
    at = names.index(ids_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = once(("trie", model_path, 1.0), lambda: Trie(sent(), 1.0))
        for b in batches:
            texts = [None if x is None else decode(trie, np.array(x, np.int64)).decode() for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, out])

    return arrow_map(rows, run, schema)
