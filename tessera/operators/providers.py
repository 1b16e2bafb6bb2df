"""Pluggable models: encoders and rerankers, with deterministic stand-ins that need no files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# The public sentence encoders that can be named, with their revisions and prefixes.
MODELS = {
    "minilm": {"repository": "sentence-transformers/all-MiniLM-L6-v2", "revision": "1110a243fdf4706b3f48f1d95db1a4f5529b4d41", "query_prefix": "", "document_prefix": ""},
    "mpnet": {"repository": "sentence-transformers/all-mpnet-base-v2", "revision": "e8c3b32edf5434bc2275fc9bab85f82640a19130", "query_prefix": "", "document_prefix": ""},
    "bgebase": {"repository": "BAAI/bge-base-en-v1.5", "revision": "a5beb1e3e68b9ab74eb54cfd186867f64f240e1a", "query_prefix": "Represent this sentence for searching relevant passages: ", "document_prefix": ""},
    "nomic": {"repository": "nomic-ai/nomic-embed-text-v1.5", "revision": "e9b6763023c676ca8431644204f50c2b100d9aab", "query_prefix": "search_query: ", "document_prefix": "search_document: "},
}


def model(name: str) -> dict[str, str]:
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; known: {', '.join(sorted(MODELS))}")
    return MODELS[name]


def prepared(text: Column, name: str, kind: str) -> Column:
    """What is given to the model: its prefix for a `query` or `document`, and the text."""
    return F.concat(F.lit(model(name)[f"{kind}_prefix"]), F.coalesce(text, F.lit("")))


class Encoder(Protocol):
    """Texts to vectors; made once a worker by `load`."""

    width: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class HashingEncoder:
    """Unit vectors of signed token counts in hashed buckets."""

    def __init__(self, width: int = 64):
        self.width = width

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for i, text in enumerate(texts):
            for token in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
                out[i, h % self.width] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


class OverlapScorer:
    """Share of the query's words that the text has."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            want = set(query.lower().split())
            out.append(round(len(want & set(text.lower().split())) / len(want), 6) if want else 0.0)
        return out


def embed(chunks: DataFrame, encoder: Encoder, text: str = "text", prefix: str = "", out: str = "embedding") -> DataFrame:
    """Adds unit vectors of prefix + text, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(list(encoder.encode([prefix + (t or "") for t in p])))

    return chunks.withColumn(out, run(F.col(text)))


def rerank(pairs: DataFrame, scorer: Scorer, id_col: str, k: int) -> DataFrame:
    """Scores (query, text) pairs and keeps the k best a query; ties go to the smaller id."""

    @F.pandas_udf("double")
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(scorer.score([(q or "", t or "") for q, t in zip(query, text)]))

    scored = pairs.withColumn("score", run("query", "text")).drop("query", "text")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
