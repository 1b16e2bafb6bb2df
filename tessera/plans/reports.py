"""The chunk report and the chunk constraints over rendered filings, some of them damaged by rule so that every figure moves."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.jobs import CONFIG
from tessera.operators import chunker, migration, reports
from tessera.plans import filings
from tessera.plans.chunks import TOKENS
from tessera.sources.store import once, stored, version
from tessera.sources.tables import table

CASES = 17


def _at(case: int, name: str, number: int) -> Column:
    return (F.col("doc") % CASES == case) & (F.col(name) == number)


def _entries(name: str) -> Column:
    return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of all filings, cut once a Spark application; one filing in 17 is damaged in each of eleven ways."""
    made_from = tuple(version(spark, f"{sf}/{n}.parquet") for n in ("customer", "nation", "orders"))
    whole = once(spark, ("filing-chunks", sf, made_from), lambda: stored(chunker.chunk_blocks(filings.blocks(spark, sf), CONFIG), "filing-chunks"))
    one = lambda k: F.concat(F.col("doc").cast("string"), F.lit(f"-0-{k:06d}"))
    at = lambda case, number: _at(case, "chunk_index", number)
    return whole.filter(~at(1, 3)).withColumns({
        "text": F.when(at(2, 5), " ").when(at(4, 9), F.replace("text", F.lit("---"), F.lit("x"))).otherwise(F.col("text")),
        "logical_table_id": F.when(at(5, 11), F.concat(F.col("doc").cast("string"), F.lit("-0-TABLE-0008"))).otherwise(F.col("logical_table_id")),
        "n_tokens": F.when(at(6, 1), 501).otherwise(F.col("n_tokens")),
        "chunking_config_sha256": F.when(at(9, 4), "other").otherwise(F.col("chunking_config_sha256")),
        "block_ids": F.when(at(3, 7), F.slice("block_ids", 1, 1)).when(at(7, 2), F.concat("block_ids", F.array(F.lit("nowhere")))).when(at(8, 3), F.concat("block_ids", "block_ids"))
        .when(at(10, 12), F.array().cast("array<string>")).when(at(14, 2), F.concat("block_ids", F.array(one(1)))).otherwise(F.col("block_ids")),
    })


def filing_chunk_report(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics record of every filing's chunks."""
    found = reports.chunk_report(chunks(spark, sf), filings.blocks(spark, sf), CONFIG)
    return found.withColumns({f"{n}_counts": _entries(f"{n}_counts") for n in reports.COUNTED}).drop("chunking_config_sha256")


def filing_chunk_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """How often each constraint finds the damaged chunks and blocks."""
    b = filings.blocks(spark, sf)
    at = lambda case, number: _at(case, "block_index", number)
    damaged = b.withColumns({
        "logical_column_units": F.when(at(11, 13), F.slice("logical_column_units", 1, 1)).otherwise(F.col("logical_column_units")),
        "logical_rows": F.when(at(12, 19), F.transform("logical_rows", lambda r, i: F.when(i == 0, F.concat(F.array(F.lit("")), F.slice(r, 2, F.size(r) - 1))).otherwise(r))).otherwise(F.col("logical_rows")),
        "logical_row_source_indexes": F.when(at(13, 22), F.slice("logical_row_source_indexes", 1, 1)).otherwise(F.col("logical_row_source_indexes")),
        "logical_cell_states": F.when(at(15, 24), F.array().cast("array<array<string>>")).otherwise(F.col("logical_cell_states")),
        "source_cells": F.when(at(16, 11), 0).otherwise(F.col("source_cells")),
    })
    return reports.chunk_constraints(chunks(spark, sf), damaged, CONFIG).groupBy("rule").agg(F.count(F.lit(1)).alias("found"))


def _damaged_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks of all filings; one filing in 17 has another title, density, kind, header, text, link or cell in each of ten ways."""
    at = lambda case, number: _at(case, "block_index", number)
    changed = lambda name, *cases: {name: functools.reduce(lambda w, c: w.when(at(c[0], c[1]), c[2]), cases[1:], F.when(at(cases[0][0], cases[0][1]), cases[0][2])).otherwise(F.col(name))}
    return filings.blocks(spark, sf).withColumns(
        changed("title", (1, 13, "Notes to financial statements"), (2, 13, "F-12"), (5, 19, "Regions (Continued)"), (7, 13, "x" * 501), (11, 22, "ACME HOLDINGS INC."), (12, 22, "List of"))
        | changed("logical_empty_density", (3, 11, 0.75)) | changed("continued_from_block_id", (4, 14, F.lit(None).cast("string"))) | changed("content_type", (6, 24, "navigation")) | changed("table_kind", (6, 24, "unknown"))
        | changed("logical_column_headers", (8, 16, F.array(F.lit("Line item"), F.lit(""), F.lit("Value")))) | changed("text", (9, 19, F.replace("text", F.lit("---"), F.lit("x")))) | changed("logical_rows", (10, 22, F.array(F.array(F.lit("$"), F.lit("x")))))
    )


def filing_table_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, distributions, continuations and gates of the tables of every filing and of the corpus."""
    found = reports.table_audit(_damaged_blocks(spark, sf))
    return found.withColumns({f"{n}_counts": _entries(f"{n}_counts") for n in reports.AUDITED} | {n: F.round(n, 6) for n in found.columns if n.startswith(("physical_empty", "logical_empty", "width_ratio"))})


def filing_table_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Failures and warnings of every table."""
    return reports.table_findings(_damaged_blocks(spark, sf))


def gold_faults(spark: SparkSession, sf: str) -> DataFrame:
    """A gold record a customer, naming chunks of the customer's filing; some are not approved, empty, doubled or name no chunk."""
    key = F.col("c_custkey").cast("string")
    case = lambda n: F.col("c_custkey") % CASES == n
    named = lambda *numbers: F.array(*[F.concat(key, F.lit(f"-CHUNK-{n:06d}")) for n in numbers])
    relevant = F.when(case(2), F.array().cast("array<string>")).when(case(3), named(1, 5, 1)).when(case(4), named(1, 99)).when(case(5), F.lit(None).cast("array<string>")).otherwise(named(1, 5))
    records = table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.when(case(1), "pending").otherwise("approved").alias("status"), relevant.alias("relevant"))
    return migration.gold_violations(records, chunks(spark, sf), records=60)


QUERIES = {f.__name__: f for f in (filing_chunk_report, filing_chunk_constraints, filing_table_audit, filing_table_findings, gold_faults)}

# (case, rule, rows found in one filing)
_FOUND = [
    (1, "index_gap", 10), (1, "uncovered_block", 1), (2, "blank_text", 1), (2, "invalid_markdown", 1), (3, "other_fragments", 1), (3, "uncovered_block", 1), (4, "invalid_markdown", 1),
    (5, "repeated_table", 2), (5, "other_fragments", 1), (6, "too_long", 1), (7, "unknown_block", 1), (8, "repeated_fragment", 1), (9, "other_config", 1), (10, "no_blocks", 1),
    (10, "uncovered_block", 1), (11, "fragment_width", 1), (12, "blank_present", 1), (13, "fragment_sources", 1), (13, "composed_sources", 1), (15, "fragment_states", 1), (16, "no_source_cells", 1),
]
_SHARE = "round(coalesce(avg(({})::INT) FILTER ({}), {}), 6)"


def _report_sql() -> str:
    counted = ", ".join(f"(SELECT string_agg(v || '=' || n, '|' ORDER BY v) FROM (SELECT coalesce({c}, 'none') AS v, count(*) AS n FROM r AS x WHERE x.doc = g.doc AND x.content_type = 'table' GROUP BY 1)) AS {c}_counts" for c in reports.COUNTED)
    source = filings.ORACLE_SQL
    return f"""WITH c AS (SELECT *, doc % {CASES} AS m FROM ({source["filing_chunks"]})),
b AS ({source["filing_blocks"]}), t AS ({source["filing_tables"]}), k AS ({source["filing_compositions"]}),
d AS (SELECT doc, chunk_id, chunk_index, content_type, composition_mode,
  CASE WHEN m = 2 AND chunk_index = 5 THEN ' ' WHEN m = 4 AND chunk_index = 9 THEN replace(text, '---', 'x') ELSE text END AS text,
  CASE WHEN m = 5 AND chunk_index = 11 THEN doc || '-0-TABLE-0008' ELSE logical_table_id END AS logical_table_id,
  CASE WHEN m = 6 AND chunk_index = 1 THEN 501 ELSE len({TOKENS}) END AS n,
  CASE WHEN m = 3 AND chunk_index = 7 THEN string_split(block_ids, '|')[1:1] WHEN m = 10 AND chunk_index = 12 THEN [] WHEN m = 14 AND chunk_index = 2 THEN string_split(block_ids, '|') || [doc || '-0-000001'] ELSE string_split(block_ids, '|') END AS ids
  FROM c WHERE NOT (m = 1 AND chunk_index = 3)),
u AS (SELECT doc, chunk_id, unnest(ids) AS block_id FROM d),
s AS (SELECT u.doc, chunk_id, count(DISTINCT section) AS sections FROM u JOIN b ON u.doc = b.doc AND u.block_id = b.block_id GROUP BY ALL),
f AS (SELECT k.doc, k.logical_table_id, k.mode, k.title, k.headers, k.context, k.fragments, t.table_kind, t.header_mode, t.title_source, t.units, b.content_type AS table_class
  FROM k JOIN b ON b.doc = k.doc AND b.block_id = string_split(k.block_ids, '|')[1] JOIN t ON t.doc = k.doc AND t.block_index = b.block_index),
r AS (SELECT d.*, coalesce(sections, 0) AS sections, fragments, table_kind, header_mode, title_source, table_class,
  contains(d.text, coalesce(f.title, '')) AND (mode = 'compound' OR contains(d.text, coalesce('Units: ' || units, ''))) AND (coalesce(context, '') = '' OR contains(d.text, 'Context: ' || context))
    AND len(list_filter(string_split(coalesce(headers, ''), '|'), lambda h: NOT contains(d.text, h))) = 0 AS copied,
  NOT (d.text = ' ' OR contains(d.text, '| x |')) AS valid
  FROM d LEFT JOIN f ON f.doc = d.doc AND f.logical_table_id = d.logical_table_id LEFT JOIN s ON s.doc = d.doc AND s.chunk_id = d.chunk_id),
g AS (SELECT doc, count(*) AS chunk_count, count_if(content_type = 'narrative') AS narrative_chunks, count_if(content_type = 'table') AS table_chunks, min(n)::INT AS length_min, quantile_cont(n, 0.5) AS length_median,
  quantile_disc(n, 0.95)::DOUBLE AS length_p95, max(n)::INT AS length_max, {_SHARE.format("regexp_matches(text, '[.!?;:][\"'')\\]]*$')", "content_type = 'narrative'", 0)} AS boundary_accuracy, {_SHARE.format("sections <= 1", "true", 1)} AS section_accuracy,
  {_SHARE.format("copied", "content_type = 'table'", 1)} AS table_context_copy_completeness, count(DISTINCT logical_table_id) AS logical_table_count, sum(fragments)::BIGINT AS table_fragment_count, sum(fragments - 1)::BIGINT AS accepted_continuation_link_count,
  max(n) FILTER (content_type = 'table')::INT AS table_length_max, count_if(content_type = 'table' AND n > {CONFIG["chunk_size"]}) AS table_inputs_over_narrative_limit, {_SHARE.format("valid", "content_type = 'table'", 1)} AS table_markdown_validity FROM r GROUP BY doc),
v AS (SELECT b.doc, round(count_if(EXISTS (SELECT 1 FROM u WHERE u.doc = b.doc AND u.block_id = b.block_id)) / count(*), 6) AS source_block_coverage FROM b WHERE content_type <> 'heading' GROUP BY b.doc)
SELECT g.*, v.source_block_coverage, 1.0::DOUBLE AS source_anchor_coverage, 0.0::DOUBLE AS actual_overlap_median, 0::BIGINT AS standalone_marker_count, 0.0::DOUBLE AS logical_empty_density_median, 0.0::DOUBLE AS logical_empty_density_p95,
  0.0::DOUBLE AS logical_empty_density_max, 0::BIGINT AS logical_tables_over_50_percent_empty, {counted}, '{CONFIG["strategy"]}' AS strategy, '{CONFIG["length_function"]}' AS length_function,
  {CONFIG["chunk_size"]} AS chunk_size, {CONFIG["chunk_overlap"]} AS configured_overlap, {CONFIG["schema_version"]} AS chunk_schema_version, {CONFIG["table_schema_version"]} AS table_schema_version FROM g JOIN v USING (doc)"""


_DISTRIBUTED = ("logical_width", "physical_empty_density", "logical_empty_density", "width_ratio")


def _audit_sql() -> str:
    """The tables as the templates state them, damaged alike; `g` has every row twice: under its filing and under all."""
    source = filings.ORACLE_SQL
    listed = {"title_quality": "flags", "continuation_rejection": "rejections"}
    counts = ", ".join(f"(SELECT string_agg(v || '=' || n, '|' ORDER BY v) FROM (SELECT v, count(*) AS n FROM (SELECT {f'unnest({listed[c]})' if c in listed else f'coalesce({c}, {chr(39)}none{chr(39)})'} AS v FROM g AS x WHERE x.corpus = y.corpus AND x.filing IS NOT DISTINCT FROM y.filing) GROUP BY v)) AS {c}_counts" for c in reports.AUDITED)
    real = lambda x, c: x if c == "logical_width" else f"round({x}, 6)::DOUBLE"
    spread = ", ".join(f"{real(f'min({c})', c)} AS {c}_min, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS {c}_median, round(quantile_disc({c}, 0.95), 6)::DOUBLE AS {c}_p95, {real(f'max({c})', c)} AS {c}_max" for c in _DISTRIBUTED)
    return f"""WITH b AS ({source["filing_blocks"]}), k AS ({source["filing_compositions"]}), i AS (SELECT doc, logical_table_id, unnest(string_split(block_ids, '|')) AS block_id FROM k),
t AS (SELECT t.* REPLACE (
    CASE WHEN m = 1 AND t.block_index = 13 THEN 'Notes to financial statements' WHEN m = 2 AND t.block_index = 13 THEN 'F-12' WHEN m = 5 AND t.block_index = 19 THEN 'Regions (Continued)' WHEN m = 7 AND t.block_index = 13 THEN repeat('x', 501)
      WHEN m = 11 AND t.block_index = 22 THEN 'ACME HOLDINGS INC.' WHEN m = 12 AND t.block_index = 22 THEN 'List of' ELSE title END AS title,
    CASE WHEN m = 3 AND t.block_index = 11 THEN 0.75 ELSE logical_empty_density END AS logical_empty_density, CASE WHEN m = 4 AND t.block_index = 14 THEN NULL ELSE continued_from_block_id END AS continued_from_block_id,
    CASE WHEN m = 6 AND t.block_index = 24 THEN 'unknown' ELSE table_kind END AS table_kind), CASE WHEN m = 6 AND t.block_index = 24 THEN 'navigation' ELSE content_type END AS table_class, b.block_id, i.logical_table_id, m
  FROM (SELECT *, doc % {CASES} AS m FROM ({source["filing_tables"]})) t JOIN b ON b.doc = t.doc AND b.block_index = t.block_index LEFT JOIN i ON i.doc = b.doc AND i.block_id = b.block_id),
r AS (SELECT *, CASE WHEN title IS NULL THEN ['missing'] WHEN m = 1 AND block_index = 13 THEN ['generic_notes'] WHEN m = 2 AND block_index = 13 THEN ['page_label'] WHEN length(title) > 500 THEN ['overlong'] WHEN title = 'ACME HOLDINGS INC.' THEN ['company_header'] WHEN title = 'List of' THEN ['truncated_looking'] ELSE ['accepted'] END AS flags,
  CASE title_source WHEN 'none' THEN 'missing' WHEN 'internal_title_row' THEN 'internal' WHEN 'inherited' THEN 'inherited' ELSE 'nearby' END AS title_review,
  CASE WHEN continued_from_block_id IS NULL AND continuation <> 'no_previous_table' THEN string_split(continuation, '|') ELSE [] END AS rejections,
  continued_from_block_id IS NULL AND contains(coalesce(title, ''), '(Continued)') AS orphan, CASE WHEN header_mode <> 'headerless' THEN NOT (m = 8 AND block_index = 16) END AS headed,
  table_kind IN ('financial_data', 'structured_text') AS counted, (m = 10 AND block_index = 22)::INT AS strays, NOT (m = 9 AND block_index = 19) AS markdown FROM t),
g AS (SELECT *, doc AS filing, false AS corpus FROM r UNION ALL SELECT *, NULL, true FROM r),
y AS (SELECT filing, corpus, count(*) AS table_fragments, count(DISTINCT logical_table_id) AS logical_tables, count(DISTINCT logical_table_id) FILTER (table_class <> 'navigation') AS included_logical_tables,
  count(DISTINCT logical_table_id) FILTER (table_class = 'navigation') AS navigation_logical_tables, count(continued_from_block_id) AS accepted_links, count_if(len(rejections) > 0) AS rejected_pairs,
  count(continued_from_block_id) + count_if(len(rejections) > 0) AS candidate_pairs, count_if(orphan) AS orphan_cues, {spread}, count_if(counted) AS density_tables, count_if(counted AND logical_empty_density > 0.5) AS dense_tables,
  round(count_if(counted AND logical_empty_density > 0.5) / count_if(counted), 6) AS dense_rate, count(headed) AS headed_tables, round(avg(headed::INT), 6) AS complete_header_rate, sum(strays)::BIGINT AS standalone_markers, round(avg(markdown::INT), 6) AS markdown_validity,
  count_if(title_source = 'none') AS missing_titles, count_if(title_source = 'none' AND table_kind = 'financial_data') AS missing_financial_titles, count_if(table_kind = 'unknown') AS unknown_tables,
  count_if(counted AND logical_empty_density > 0.5) <= 0.05 * count_if(counted) AS density_gate FROM g GROUP BY ALL),
c AS (SELECT doc AS filing, false AS corpus, count(*) AS blocks FROM b GROUP BY doc UNION ALL SELECT NULL, true, count(*) FROM b)
SELECT y.* EXCLUDE (filing), y.filing AS doc, c.blocks, c.blocks - table_fragments AS narrative_blocks, {counts} FROM y JOIN c ON c.corpus = y.corpus AND c.filing IS NOT DISTINCT FROM y.filing"""


def _findings_sql() -> str:
    first = _audit_sql().split(",\ng AS (")[0]
    rules = {
        "failure": {"standalone_marker": "strays > 0", "invalid_markdown": "NOT markdown", "invalid_financial_title": "table_kind = 'financial_data' AND flags[1] IN ('generic_notes', 'page_label')"},
        "warning": {"missing_title": "title_source = 'none'", "overlong_title": "flags[1] = 'overlong'", "unknown_kind": "table_kind = 'unknown'", "orphan_continued_cue": "orphan", "mostly_empty": "counted AND logical_empty_density > 0.5"},
    }
    return first + " " + " UNION ALL ".join(f"SELECT doc, block_id, '{level}' AS level, '{name}' AS rule FROM r WHERE {rule}" for level, named in rules.items() for name, rule in named.items())


ORACLE_SQL = {
    "gold_faults": f"""SELECT c_custkey AS record_id, unnest(CASE c_custkey % {CASES} WHEN 1 THEN ['not_approved'] WHEN 2 THEN ['no_gold'] WHEN 3 THEN ['repeated_gold'] WHEN 4 THEN ['unknown_chunk'] WHEN 5 THEN ['no_gold'] ELSE [] END) AS rule FROM customer
UNION ALL SELECT NULL, 'record_count' FROM customer HAVING count(*) <> 60 UNION ALL SELECT NULL, 'mixed_config' FROM customer HAVING count_if(c_custkey % {CASES} = 9) > 0""",
    "filing_chunk_report": _report_sql(),
    "filing_table_audit": _audit_sql(),
    "filing_table_findings": _findings_sql(),
    "filing_chunk_constraints": f"""SELECT rule, (sum(n) FILTER (m IS NOT NULL))::BIGINT AS found FROM (VALUES {", ".join(f"({m}, '{rule}', {n})" for m, rule, n in _FOUND)}) t(wanted, rule, n)
JOIN (SELECT c_custkey % {CASES} AS m FROM customer) ON m = wanted GROUP BY rule""",
}
