"""Edge cases of the chunk and table reports."""

import pytest
from pyspark.sql import functions as F

from tests.test_pipeline_parts import PAGE
from tessera.jobs import CONFIG
from tessera.operators import chunker, migration, reports
from tessera.operators.html import html_blocks


@pytest.fixture(scope="module")
def made(spark):
    blocks = html_blocks(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")).cache()
    return blocks, chunker.chunk_blocks(blocks, CONFIG).cache()


def test_markdown_runs(spark):
    good = ["| a | b |\n| --- | ---: |\n| 1 | 2 |", "title\n\n| a |\n| --- |", "| a\\|b |\n| --- |\n\ntext\n\n| c | d |\n| :---: | --- |\n| | |"]
    bad = ["", "no table", "| a | b |", "| a |\n| --- |\n| 1 | 2 |", "| a |\n| b |", "| a |\n| --- |\n\n| c |", "| a | b |\n| --- |"]
    rows = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "text string, valid boolean")
    assert rows.filter(reports.valid_markdown(F.col("text")) != F.col("valid")).count() == 0


def test_title_flags(spark):
    wanted = {None: ["missing"], "  ": ["missing"], "Revenue": ["accepted"], "Notes to consolidated financial statements — (continued)": ["generic_notes"], "F-7": ["page_label"], "12": ["page_label"], "ACME CORP": ["company_header"], "Sum of": ["truncated_looking"], "x" * 501: ["overlong"]}
    rows = spark.createDataFrame([(t,) for t in wanted], "title string")
    assert {r.title: r.flags for r in rows.select("title", reports.title_flags(F.col("title")).alias("flags")).collect()} == wanted


def test_reports_of_nothing(spark, made):
    blocks, chunks = made
    none_b, none_c = blocks.filter("false"), chunks.filter("false")
    assert reports.chunk_report(none_c, none_b, CONFIG).count() == 0
    assert reports.chunk_constraints(none_c, none_b, CONFIG).count() == 0
    assert reports.table_findings(none_b).count() == 0
    assert reports.table_audit(none_b).count() == 0
    empty = spark.createDataFrame([], "record_id long, status string, relevant array<string>")
    assert {r.rule for r in migration.gold_violations(empty, none_c, records=1).collect()} == {"record_count", "no_tables"}


def test_report_of_sound_chunks(spark, made):
    blocks, chunks = made
    assert reports.chunk_constraints(chunks, blocks, CONFIG).count() == 0
    [row] = reports.chunk_report(chunks, blocks, CONFIG).collect()
    assert row.chunk_count == chunks.count() == row.narrative_chunks + row.table_chunks
    assert row.source_block_coverage == 1.0 and row.table_markdown_validity == 1.0 and row.length_max <= CONFIG["chunk_size"]
    assert sum((row.composition_mode_counts or {}).values()) == row.table_chunks
    null_text = chunks.withColumn("text", F.lit(None).cast("string"))
    [row] = reports.chunk_report(null_text, blocks, CONFIG).collect()
    assert row.boundary_accuracy == 0.0


def test_overlap_in_tokens(spark):
    text = " ".join(f"word{i}." for i in range(60))
    page = f'<html><body><p><b>Item 1. Business</b></p><p>{text}</p></body></html>'
    blocks = html_blocks(spark.createDataFrame([(1, page)], "page_id long, html string"))
    config = CONFIG | {"chunk_size": 40, "chunk_overlap": 6, "strategy": "fixed"}
    chunks = chunker.chunk_blocks(blocks, config)
    [row] = reports.chunk_report(chunks, blocks, config).collect()
    assert row.chunk_count > 2 and row.actual_overlap_median == 6


def test_markdown_with_escapes_and_blanks(spark):
    head = "| a | b |\n| --- | --- |\n"
    texts = {head + "| \\| | c |": True, head + "| c \\|": True, head + "  | c | d |  ": True, head + "| c | d |\\ ": True, head + "| c | d | \\": True, head + "| \\\\| d |": True, head + "| \\| d |": False, head + "| \\\\ | d |": True, head + "| --- | --- | --- |": False, "| a |\n| -- |": False, "| a |\n--- |": False, "|\n|---|": False, "|": False}
    rows = spark.createDataFrame(list(texts.items()), "text string, valid boolean").withColumn("found", reports.valid_markdown(F.col("text")))
    assert {r.text: r.found for r in rows.collect()} == texts
    assert "regexp_count" not in str(reports.valid_markdown(F.col("text")))  # no regular expression a line but for rules
