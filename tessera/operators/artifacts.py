"""Artifacts on disk: JSON lines, JSON objects, vectors, run results, reports in Markdown, and their hashes.

Tables are written by Spark's committer (all files or none), single files through `release.Store`
(written beside and renamed over), so a reader never sees half of either.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BEGIN, END = "<!-- results:begin -->", "<!-- results:end -->"


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """One JSON object a line, nulls kept; an existing target is an error unless `overwrite`."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)
    return path


def file_hashes(spark: SparkSession, path: str, prefixed: bool = False) -> DataFrame:
    """(name, bytes, sha256) of every file of a folder."""
    digest = F.sha2("content", 256)
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), (F.concat(F.lit("sha256:"), digest) if prefixed else digest).alias("sha256"))


def with_metadata(results: DataFrame, metadata: dict[str, str | int | float]) -> DataFrame:
    """Every result with the facts of its run; a result's own column of that name stays."""
    return results.select("*", *[F.lit(v).alias(k) for k, v in metadata.items() if k not in results.columns])


def write_vectors(chunks: DataFrame, path: str, vector: str = "embedding", overwrite: bool = False) -> str:
    """Parquet of (chunk_id, text_sha256, embedding): ids, hashes and vectors stay together whatever the order."""
    rows = chunks.select("chunk_id", F.sha2("text", 256).alias("text_sha256"), F.col(vector).cast("array<float>").alias("embedding"))
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return path


def vector_manifest(vectors: DataFrame) -> DataFrame:
    """One row: vectors, distinct ids, width, and a digest that counts every row (a sum of row hashes, so equal rows do not cancel)."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", "chunk_id", "text_sha256"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("chunk_id").alias("ids"), F.min(F.size("embedding")).alias("width_min"), F.max(F.size("embedding")).alias("width_max"), F.sum(row).cast("string").alias("digest"))


def format_seconds(value: Column) -> Column:
    """Two places; a half goes to the even digit (Java's own formats round it up)."""
    return F.format_string("%.2f s", F.bround(value.cast("double"), 2))


def format_bytes(value: Column) -> Column:
    return F.format_string("%.1f MiB", F.bround(value.cast("double") / (1024 * 1024), 1))


def format_count(value: Column) -> Column:
    return F.format_number(value, 0)


def percentage(value: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(value.cast("double") * 100, 1))


def report_line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("—")) for c in cells]), F.lit(" |"))


def report(rows: DataFrame, title: str, columns: dict[str, Column], order: list[Column]) -> str:
    """A Markdown report: a title, a table of the columns, and the rows themselves as JSON between two marks, for `report_rows`.

    A report is for people: its rows (one a model or setting) pass through the driver.
    """
    found = rows.orderBy(*order).select(report_line(*columns.values()).alias("line"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("data")).collect()
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([f"# {title}", "", *head, *[r.line for r in found], "", BEGIN, json.dumps([json.loads(r.data) for r in found], sort_keys=True, ensure_ascii=False), END, ""])


def report_rows(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """The rows a report carries; a report without its marks has none."""
    held = spark.createDataFrame([(text,)], "text string").select(F.regexp_extract("text", f"(?s){BEGIN}\\n(.*)\\n{END}", 1).alias("data"))
    return held.filter("data <> ''").select(F.explode(F.from_json("data", f"array<struct<{schema}>>")).alias("r")).select("r.*")


def embedding_text(table: DataFrame, company: Column | None = None, ticker: Column | None = None, section: Column | None = None, region: Column | None = None) -> Column:
    """The text a logical table is embedded by: where it stands, its headers, and a sentence for each value cell.

    `table` is what `compose.compose_tables` gives (not compound).
    """
    dash = " — "
    named = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    context = F.array_join("header_context", dash)
    lead = F.array_compact(F.array(
        *[named(n, c) for n, c in (("Company", company), ("Ticker", ticker), ("Section", section)) if c is not None],
        *([F.when(region != "filing_body", F.concat(F.lit("Document region: "), F.initcap(F.replace(region, F.lit("_"), F.lit(" ")))))] if region is not None else []),
        named("Title", F.col("title")), named("Column units", F.array_join("units", " | ")),
    ))
    headers = F.array_distinct(F.filter("headers", lambda h: h != ""))
    told = F.array_compact(F.concat(F.array(F.when(context != "", F.concat(F.lit("Header context: "), context))), headers))
    where = lambda i: F.concat_ws(dash, F.when(context != "", context), F.when(F.get("headers", i) != "", F.get("headers", i)))
    subject = lambda r, i: F.concat_ws(" for ", F.when(F.trim(F.get(r, 0)) != "", F.trim(F.get(r, 0))), F.when(where(i) != "", where(i)))
    sentences = F.flatten(F.transform("rows", lambda r: F.filter(F.transform(r, lambda v, i: F.when((i > 0) & (F.trim(v) != "") & (subject(r, i) != ""), F.concat(subject(r, i), F.lit(" was "), F.trim(v), F.lit(".")))), lambda s: s.isNotNull())))
    tail = F.array_compact(F.array(F.when(F.size(told) > 0, F.concat(F.lit("Headers:\n"), F.array_join(told, "\n"))), F.when(F.size(sentences) > 0, F.concat(F.lit("Table values:\n"), F.array_join(sentences, "\n")))))
    return F.array_join(F.concat(lead, tail), "\n")


def rerank_text(company: Column, ticker: Column, section: Column, kind: Column, text: Column, table_text: Column | None = None) -> Column:
    """What a reranker reads of a chunk: four lines of facts, then for tables the sentences before the full text."""
    of = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(F.lit("Company: "), of(company), F.lit("\nTicker: "), of(ticker), F.lit("\nSection: "), of(section), F.lit("\nContent type: "), of(kind), F.lit("\n\n"))
    if table_text is None:
        return F.concat(head, of(text))
    return F.concat(head, F.when(kind == "table", F.concat(of(table_text), F.lit("\n\nFull table:\n"))).otherwise(""), of(text))


def context_blocks(hits: DataFrame, key: str, position: str, chunk_id: str, facts: list[str], text: str) -> DataFrame:
    """(key, context): a request's chunks in order, each as a source a model can cite."""
    told = F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for c in facts])
    block = F.concat(F.lit('<source id="'), F.col(chunk_id).cast("string"), F.lit('" '), told, F.lit(">\n"), F.coalesce(text, F.lit("")), F.lit("\n</source>"))
    rows = hits.select(key, F.struct(F.col(position).alias("p"), block.alias("b")).alias("x"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["b"]), "\n\n").alias("context"))


def table_cells(table: DataFrame, key: list[str]) -> DataFrame:
    """(key, row, column, header, value): a composed table as one row a cell, to be pivoted or joined."""
    rows = table.select(*key, "headers", F.posexplode("rows").alias("row", "cells"))
    return rows.select(*key, "row", "headers", F.posexplode("cells").alias("column", "value")).select(*key, "row", "column", F.get("headers", F.col("column")).alias("header"), "value")
