"""Ordered blocks to chunks: islands, token windows, recursive spans, provenance and statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import p95_nearest_rank
from tessera.functions.text import TOKEN, tokens

SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def islands(blocks: DataFrame, doc: str, position: str, keys: list[Column], excluded: Column | None = None) -> DataFrame:
    """Adds `island`: runs of neighbours with equal keys, numbered from 1 a document; excluded rows break runs and drop out."""
    w = Window.partitionBy(doc).orderBy(position)
    out = F.coalesce(excluded, F.lit(False)) if excluded is not None else F.lit(False)
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    rows = blocks.withColumn("_key", key).withColumn("_out", out)
    fresh = ~F.col("_out") & (F.lag("_key").over(w).isNull() | ~F.col("_key").eqNullSafe(F.lag("_key").over(w)) | F.lag("_out").over(w))
    rows = rows.withColumn("_new", fresh.cast("int"))
    return rows.withColumn("island", F.sum("_new").over(w).cast("int")).filter(~F.col("_out")).drop("_key", "_out", "_new")


def chunk_ids(chunks: DataFrame, doc: str, order: list[str], name: str = "chunk_id") -> DataFrame:
    """Adds ids DOC-CHUNK-000001, ... in order."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy(*order))
    return chunks.withColumn(name, F.format_string("%s-CHUNK-%06d", F.col(doc).cast("string"), n))


def reappearing(blocks: DataFrame, doc: str, key: str) -> DataFrame:
    """Keys that come back after their run has ended (an error for logical tables)."""
    return blocks.groupBy(doc, key).agg(F.count_distinct("island").alias("runs")).filter("runs > 1")


def fixed_spans(docs: DataFrame, doc: str, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of `size` tokens, each starting `overlap` tokens before the last one's end: (doc, span, token_start, token_end, span_tokens)."""
    step = size - min(overlap, size - 1)
    rows = docs.select(doc, tokens(F.col(text)).alias("t")).withColumn("n", F.size("t")).filter("n > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    return rows.select(doc, "t", "n", F.explode(F.sequence(F.lit(0), last)).alias("span")).select(
        doc,
        "span",
        (F.col("span") * step).alias("token_start"),
        F.least(F.col("span") * step + size, F.col("n")).alias("token_end"),
        F.slice("t", F.col("span") * step + 1, F.lit(size)).alias("span_tokens"),
    )


def _split(text: str, size: int, separators: list[str], count) -> list[str]:
    """Pieces of at most `size` tokens: the first separator that occurs splits, too long pieces are split by the later ones."""
    if count(text) <= size:
        return [text] if text else []
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, later = separators[at], separators[at + 1 :]
    if not sep:
        return list(text)
    parts, start = [], 0
    while (hit := text.find(sep, start)) >= 0:  # a piece keeps the separator that follows it
        parts.append(text[start : hit + len(sep)])
        start = hit + len(sep)
    parts.append(text[start:])
    return [q for p in parts if p for q in (_split(p, size, later, count) if later and count(p) > size else [p])]


def recursive_windows(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[tuple[int, int]]:
    """Character spans of the recursive splitter: pieces are merged up to `size` tokens, a span repeats up to `overlap` tokens of the last."""
    import regex

    pattern = regex.compile(TOKEN)
    count = lambda s: len(pattern.findall(s))
    parts = _split(text, size, separators, count)
    weights = [count(p) for p in parts]
    ends = []
    total = 0
    for p in parts:
        total += len(p)
        ends.append(total)
    spans, first, held = [], 0, 0
    for i, w in enumerate(weights):
        if i > first and held + w > size:
            spans.append((first, i))
            while first < i and (held > overlap or (held + w > size and held > 0)):
                held -= weights[first]
                first += 1
        held += w
    if first < len(parts):
        spans.append((first, len(parts)))
    out = []
    for a, b in spans:
        start, end = (ends[a - 1] if a else 0), ends[b - 1]
        body = text[start:end]
        lead = len(body) - len(body.lstrip())
        if body.strip():
            out.append((start + lead, start + len(body.rstrip())))
    return out


def recursive_spans(docs: DataFrame, doc: str, text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> DataFrame:
    """(doc, span, char_start, char_end) of the recursive splitter over whole texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, k, a, b) for d, t in zip(f["doc"], f["text"]) if t for k, (a, b) in enumerate(recursive_windows(t, size, overlap, separators))]
            yield pd.DataFrame(rows, columns=["doc", "span", "char_start", "char_end"])

    found = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).mapInPandas(run, "doc long, span int, char_start int, char_end int")
    return found.withColumnRenamed("doc", doc)


def block_offsets(blocks: DataFrame, doc: str, position: str, length: Column, gap: int = 2) -> DataFrame:
    """Adds the character span of each block in its document's body (blocks joined with `gap` characters between)."""
    w = Window.partitionBy(doc).orderBy(position)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("_n", length).withColumn("block_start", F.coalesce(F.sum(F.col("_n") + gap).over(before), F.lit(0)).cast("long")).withColumn("block_end", F.col("block_start") + F.col("_n")).drop("_n")


def provenance(spans: DataFrame, blocks: DataFrame, doc: str, bucket: int = 4096) -> DataFrame:
    """Span and block pairs that overlap. The range join is an equi-join on (document, bucket), with each pair kept in one bucket only."""
    cut = lambda df, a, b: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.greatest(F.col(a) + 1, F.col(b)) - 1) / bucket))))
    s, t = cut(spans, "start", "end"), cut(blocks, "block_start", "block_end")
    first = F.floor(F.greatest(F.col("start"), F.col("block_start")) / bucket)
    return s.join(t, [doc, "_b"]).filter((F.col("block_end") > F.col("start")) & (F.col("block_start") < F.col("end")) & (F.col("_b") == first)).drop("_b")


def overlaps(spans: DataFrame, doc: str, order: str, start: str = "token_start", end: str = "token_end") -> DataFrame:
    """Adds `overlap_tokens`: tokens shared with the previous span of the document (0 for the first)."""
    w = Window.partitionBy(doc).orderBy(order)
    return spans.withColumn("overlap_tokens", F.greatest(F.lit(0), F.coalesce(F.lag(end).over(w) - F.col(start), F.lit(0))))


def statistics(chunks: DataFrame, length: str, text: str, group: str | None = None) -> DataFrame:
    """Chunks, their lengths (min, mean, median, p95 by nearest rank, max) and the share that ends a sentence or line."""
    ends = F.regexp_like(F.rtrim(F.col(text)), F.lit(r"[.!?:;]$"))
    x = F.col(length)
    aggregates = [
        F.count(F.lit(1)).alias("chunks"),
        F.min(x).alias("length_min"),
        F.round(F.avg(x), 6).alias("length_mean"),
        F.percentile(x, F.lit(0.5)).alias("length_median"),
        p95_nearest_rank(length).alias("length_p95"),
        F.max(x).alias("length_max"),
        F.round(F.avg(ends.cast("int")), 6).alias("boundary_accuracy"),
    ]
    return (chunks.groupBy(group) if group else chunks).agg(*aggregates)


def coverage(chunk_sources: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """One row: blocks, blocks some chunk came from, and their share."""
    hit = blocks.select(*key).join(chunk_sources.select(*key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return hit.agg(F.count(F.lit(1)).alias("blocks"), F.count("_hit").alias("covered"), F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("coverage"))


def experiments(docs: DataFrame, doc: str, text: str, settings: list[tuple[str, int, int]]) -> DataFrame:
    """Chunk counts and lengths for each (strategy, size, overlap); a setting that cannot be run keeps a row without figures."""
    out = None
    for strategy, size, overlap in settings:
        label = [F.lit(strategy).alias("strategy"), F.lit(size).alias("size"), F.lit(overlap).alias("overlap")]
        if not 0 <= overlap < size:
            one = docs.sparkSession.range(1).select(*label, F.lit(False).alias("feasible"), F.lit(None).cast("long").alias("chunks"), F.lit(None).cast("double").alias("mean_length"))
        else:
            if strategy == "fixed":
                lengths = fixed_spans(docs, doc, text, size, overlap).select((F.col("token_end") - F.col("token_start")).alias("n"))
            else:
                spans = recursive_spans(docs, doc, text, size, overlap).join(docs.select(F.col(doc).cast("long").alias(doc), F.col(text).alias("_t")), doc)
                lengths = spans.select(F.size(tokens(F.substr("_t", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))).alias("n"))
            one = lengths.agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("n"), 6).alias("mean_length")).select(*label, F.lit(True).alias("feasible"), "chunks", "mean_length")
        out = one if out is None else out.unionByName(one)
    return out
