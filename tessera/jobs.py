"""Jobs: each reads tables, applies operators, and writes one table; none overwrites unless told to."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import audit, bm25, chunker, dense, fusion, html, metrics, providers, release, reports, scope

# The production chunking.
CONFIG = {
    "schema_version": 3, "table_schema_version": 2, "chunk_size": 500, "chunk_overlap": 32, "length_function": "tokens", "strategy": "recursive",
    "separators": ["\n\n", "\n", ". ", " ", ""],
}


def save(df: DataFrame, path: str, overwrite: bool) -> DataFrame:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def blocks(spark: SparkSession, pages: str, out: str, whole_body: bool = False, overwrite: bool = False) -> DataFrame:
    """HTML pages (page_id, html) to blocks; stops if a block breaks a rule."""
    made = save(html.html_blocks(spark.read.parquet(pages), whole_body=whole_body), out, overwrite)
    refuse(audit.block_violations(made))
    return made


def chunks(spark: SparkSession, blocks_path: str, out: str, config: dict | None = None, overwrite: bool = False) -> DataFrame:
    config = chunker.validate_config(config or CONFIG)
    source = spark.read.parquet(blocks_path)
    made = save(chunker.chunk_blocks(source, config), out, overwrite)
    refuse(reports.chunk_constraints(made, source, config))
    return made


def embeddings(spark: SparkSession, chunks_path: str, out: str, width: int = 64, overwrite: bool = False) -> DataFrame:
    """Vectors by the built-in encoder; another encoder is passed to providers.embed."""
    source = spark.read.parquet(chunks_path).select("chunk_id", "text")
    vectors = providers.embed(source, providers.HashingEncoder(width)).withColumn("text_sha256", F.sha2("text", 256)).drop("text")
    made = save(vectors, out, overwrite)
    refuse(audit.embedding_violations(made, source, width))
    return made


def refuse(found: DataFrame) -> None:
    """An error that counts the broken rules, if there are any."""
    broken = {r.rule: r["count"] for r in found.groupBy("rule").count().collect()}  # one row a rule
    if broken:
        raise ValueError(f"violations: {broken}")


def search(spark: SparkSession, documents: str, queries: str, out: str, k: int = 30, overwrite: bool = False) -> DataFrame:
    """BM25 top k of every query (item_id, text), with the query's scope."""
    asked = spark.read.parquet(queries)
    found = bm25.top(bm25.scores(asked, bm25.build(spark.read.parquet(documents))).drop("share"), k)
    scopes = scope.with_scope(asked.select(F.col("item_id").alias("qid"), "text"), "text").select("qid", "scope")
    return save(found.join(scopes, "qid", "left"), out, overwrite)


def dense_search(spark: SparkSession, vectors: str, queries: str, out: str, k: int = 30, overwrite: bool = False) -> DataFrame:
    asked = spark.read.parquet(queries).select(F.col("vec_id").alias("qid"), "embedding")
    return save(dense.top(asked, spark.read.parquet(vectors), k), out, overwrite)


def fuse(spark: SparkSession, lists: list[str], out: str, id_col: str = "doc_id", rrf_k: int = 60, k: int = 30, overwrite: bool = False) -> DataFrame:
    if rrf_k < 0:
        raise ValueError("rrf_k must not be negative")
    return save(fusion.rrf([spark.read.parquet(p) for p in lists], id_col, rrf_k, k), out, overwrite)


def evaluate(spark: SparkSession, results: str, gold: str, documents: str, out: str, id_col: str = "doc_id", overwrite: bool = False) -> DataFrame:
    """Metrics of each query; gold that the corpus does not hold is an error."""
    wanted = spark.read.parquet(gold)
    lost = metrics.missing_gold(wanted, spark.read.parquet(documents), id_col).count()
    if lost:
        raise ValueError(f"{lost} gold items are not in the corpus")
    return save(metrics.per_query(wanted, spark.read.parquet(results), id_col), out, overwrite)


def report(spark: SparkSession, blocks_path: str, out: str, overwrite: bool = False) -> DataFrame:
    return save(audit.filing_report(spark.read.parquet(blocks_path)), out, overwrite)


def promote(spark: SparkSession, folder: str, tables: dict[str, str], release_id: str, preflight_only: bool = False) -> str:
    """Publish tables as the next version of a folder; with preflight_only just say what stands against it."""
    found = {name: spark.read.parquet(path) for name, path in tables.items()}
    problems = [f"{name} is empty" for name, df in found.items() if df.isEmpty()]
    if "blocks" in found and not audit.block_violations(found["blocks"]).isEmpty():
        problems.append("blocks break a rule")
    if preflight_only:
        return json.dumps({"problems": problems})
    return release.promote(spark, folder, found, release_id, problems)


def read_config(path: str | None) -> dict:
    return chunker.validate_config(json.loads(Path(path).read_text())) if path else dict(CONFIG)
