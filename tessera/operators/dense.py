"""Exact cosine search of many query vectors, by matrix products.

The corpus is read once: a task multiplies its batches with the query matrix and keeps each
query's k best, so at most queries * k rows a task are shuffled. Query vectors are sent to the
workers in blocks of at most BLOCK_QUERIES. Scores are compared at nine places; ties go to the
smaller id. Null or zero vectors are never found, nor is a vector by a query of another width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_QUERIES = 4096


def _matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width of the vectors: their places in the column, and the vectors at length one as a matrix."""
    rows = column.to_pylist()
    widths = np.array([len(r or []) for r in rows], np.int64)
    found = {}
    for width in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == width)
        out = np.array([rows[i] for i in at], np.float64)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        found[width] = at, np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
    return found


def _blocks(wanted: DataFrame) -> Iterator[list[tuple]]:
    """(qid, vector, group) rows in blocks of at most BLOCK_QUERIES; the driver holds one block at a time."""
    held: list[tuple] = []
    for row in wanted.toLocalIterator():
        held.append((row.qid, list(row.v or []), row.g))
        if len(held) == BLOCK_QUERIES:
            yield held
            held = []
    if held:
        yield held


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best finite scores with their ids, ties to the smaller id."""
    fine = np.isfinite(score)
    score, ids = score[fine], ids[fine]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def top(queries: DataFrame, corpus: DataFrame, k: int = 10, qid: str = "qid", id_col: str = "vec_id", vector: str = "embedding", group: str | None = None, same_group: bool = False) -> DataFrame:
    """(qid, id_col, score, rank). With `same_group` a query (which then has the column `group`) sees only rows of its group. Rows without an id are not found."""
    schema = "qid long, id long, score double"
    own_group = F.col(group) if same_group else F.lit(0)
    wanted = queries.select(F.col(qid).alias("qid"), F.col(vector).alias("v"), own_group.alias("g"))
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), own_group.alias("g")).filter("id IS NOT NULL")
    found = corpus.sparkSession.createDataFrame([], schema)
    for block in _blocks(wanted):
        sent = corpus.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = [q for q, _, _ in sent.value]
            asked = _matrices(pa.array([v for _, v, _ in sent.value], pa.list_(pa.float64())))
            groups = np.array([g for _, _, g in sent.value], object)
            best = [(np.empty(0), np.empty(0, np.int64)) for _ in names]
            for b in batches:
                if not b.num_rows:
                    continue
                ids = b.column(0).to_numpy(zero_copy_only=False)
                score = np.full((b.num_rows, len(names)), -np.inf)
                for width, (at, m) in _matrices(b.column(1)).items():
                    if width in asked:
                        queries_at, matrix = asked[width]
                        score[np.ix_(at, queries_at)] = np.where(m.any(axis=1)[:, None], np.round(m @ matrix.T, 9), -np.inf)
                own = np.array(b.column(2).to_pylist(), object)
                for j, (s, i) in enumerate(best):
                    new = np.where(own != groups[j], -np.inf, score[:, j]) if same_group else score[:, j]
                    some = _best(new, ids, k)
                    best[j] = _best(np.concatenate([s, some[0]]), np.concatenate([i, some[1]]), k)
            for q, (s, i) in zip(names, best):
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(s), pa.int64()), pa.array(i), pa.array(s)], ["qid", "id", "score"])

        found = found.unionByName(rows.mapInArrow(run, schema))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumnRenamed("id", id_col)


def two_pools(first: DataFrame, second: DataFrame, id_col: str) -> DataFrame:
    """Union of two ranked lists without repeats: (qid, id, first_rank, second_rank, pool_order), the first list before the second."""
    a = first.select("qid", id_col, F.col("rank").alias("first_rank"))
    b = second.select("qid", id_col, F.col("rank").alias("second_rank"))
    both = a.join(b, ["qid", id_col], "full_outer")
    order = Window.partitionBy("qid").orderBy(F.col("first_rank").asc_nulls_last(), "second_rank")
    return both.withColumn("pool_order", F.row_number().over(order))


def norm_audit(vectors: DataFrame, vector: str = "embedding", tolerance: float = 1e-3) -> DataFrame:
    """One row: vectors, those with a value that is not finite, those whose norm is not 1, and the norms' range."""
    square = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    rows = vectors.select(F.sqrt(square).alias("norm"), F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad"))
    return rows.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if("bad").alias("not_finite"),
        F.count_if(F.abs(F.col("norm") - 1) > tolerance).alias("not_unit"),
        F.round(F.min("norm"), 6).alias("norm_min"),
        F.round(F.max("norm"), 6).alias("norm_max"),
    )
