"""What a chunked corpus is judged by: the statistics record of every filing and the whole suite of chunk constraints.

Both are joins and aggregates on (filing, table) and (filing, block); nothing larger than one
logical table meets in a row. Blocks are `html_blocks` rows, chunks are `chunk_blocks` rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import distribution
from tessera.functions.text import tokens
from tessera.operators.audit import chunk_violations
from tessera.operators.chunker import config_sha256
from tessera.operators.compose import DASH, compose_tables, escape
from tessera.operators.logical import violations
from tessera.operators.tables import COMPANY_HEADER, CONTINUED, DANGLING, NOTES_HEADER, PAGE_LABEL

MARKERS = ["$", "€", "£", "¥", "%"]
NOT_BODY = ["section_label", "footnote"]
BOUNDARY = r"""[.!?;:]["')\]]*\s*$"""
COUNTED = ["table_kind", "table_class", "header_mode", "title_source", "composition_mode"]


def valid_markdown(text: Column) -> Column:
    """Whether the text has pipe lines and each run of them is a table: a delimiter row second, all rows equally wide."""
    # regular expressions only where a plain test leaves the question open: escapes in texts with a backslash, rules on lines with dashes
    bare = F.transform(F.split(F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\.", "x")).otherwise(text), "\n"), lambda x: F.trim(x))
    pipes = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|")))
    widths = F.transform(bare, lambda x: F.when(x.startswith("|") & x.endswith("|"), pipes(x)).otherwise(0))
    rules = F.transform(bare, lambda x: F.when(F.contains(x, F.lit("---")), F.regexp_like(x, F.lit(r"^\|( *:?-{3,}:? *\|)+$"))).otherwise(False))
    none = lambda n: F.array(*[F.lit(0)] * n)
    # each line beside the two before it; past the last line all are empty
    seen = F.arrays_zip(widths.alias("w"), rules.alias("rule"), F.concat(none(1), widths).alias("before"), F.concat(none(2), widths).alias("first"))
    w = lambda z, name: F.coalesce(z[name], F.lit(0))
    second = lambda z: (w(z, "before") > 0) & (w(z, "first") == 0)
    fits = F.forall(seen, lambda z: F.when(second(z), (w(z, "w") == w(z, "before")) & F.coalesce(z["rule"], F.lit(False))).when((w(z, "before") > 0) & (w(z, "w") > 0), w(z, "w") == w(z, "before")).otherwise(True))
    return fits & F.exists(widths, lambda x: x > 0)


def body_cells(rows: Column, roles: Column) -> Column:
    """Cells of all rows but section labels and footnotes."""
    kept = F.filter(F.arrays_zip(rows.alias("cells"), roles.alias("role")), lambda z: ~F.coalesce(z["role"], F.lit("")).isin(NOT_BODY))
    return F.flatten(F.transform(kept, lambda z: z["cells"]))


def _empty(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: F.coalesce(c, F.lit("")) == ""))


def table_facts(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """A row a logical table: what its first fragment says, its fragments and links, stray markers, the share of empty body cells, its composition."""
    first = lambda name, alias=None: F.min_by(name, "block_index").alias(alias or name)
    cells = body_cells(F.col("logical_rows"), F.col("logical_row_roles"))
    strays = F.size(F.filter(F.flatten("logical_rows"), lambda c: F.trim(c).isin(MARKERS)))
    by_id = blocks.filter("logical_table_id IS NOT NULL").groupBy(doc, "logical_table_id").agg(
        first("table_kind"), first("content_type", "table_class"), first("header_mode"), first("title_source"), first("units"), F.count(F.lit(1)).alias("fragments"),
        F.count("continued_from_block_id").alias("links"), F.sum(_empty(cells)).alias("_empty"), F.sum(F.size(cells)).alias("_cells"), F.sum(strays).alias("strays"),
        F.array_sort(F.collect_set("block_id")).alias("fragment_ids"),
    )
    whole = body_cells(F.col("rows"), F.col("row_roles"))
    made = compose_tables(blocks, doc).select(F.col("doc").alias(doc), "logical_table_id", F.col("title").alias("table_title"), "mode", "headers", "header_context", "width", F.col("units").alias("column_units"), "rows", "row_sources", _empty(whole).alias("_e"), F.size(whole).alias("_n"))
    share = lambda e, n: F.when(F.col(n) > 0, F.col(e) / F.col(n)).otherwise(0.0)
    return by_id.join(made, [doc, "logical_table_id"]).withColumn("empty_density", F.when(F.col("mode") == "compound", share("_empty", "_cells")).otherwise(share("_e", "_n"))).drop("_empty", "_cells", "_e", "_n")


def chunk_report(chunks: DataFrame, blocks: DataFrame, config: dict, doc: str = "doc") -> DataFrame:
    """One row a filing: chunks and their lengths, overlaps, boundaries, sections, tables by kind, densities, Markdown, coverage of its blocks and anchors.

    A share of nothing is 1, but for boundaries (0). A null text counts as empty; a filing without chunks has no row; the
    counts by kind are maps.
    """
    size = config["chunk_size"]
    table, narrative = F.col("content_type") == "table", F.col("content_type") == "narrative"
    text = F.coalesce("text", F.lit(""))
    source = blocks.select(doc, "block_id", F.coalesce("section", F.lit("")).alias("_section"), "source_anchor", (~F.col("content_type").isin("heading", "navigation")).alias("_wanted"))
    used = chunks.select(doc, "chunk_id", F.explode("block_ids").alias("block_id")).join(source, [doc, "block_id"])
    sections = used.groupBy(doc, "chunk_id").agg(F.count_distinct("_section").alias("_sections"))
    run = Window.partitionBy(doc, "source_group").orderBy("chunk_index")
    shared = F.greatest(F.lit(0), F.lag("source_text_end").over(run) - F.col("source_text_start"))
    cuts = chunks.filter(narrative).select(doc, F.size(tokens(F.right(F.lag("text").over(run), shared))).alias("overlap"), F.lag("chunk_id").over(run).isNotNull().alias("_again")).filter("_again")
    facts = table_facts(blocks, doc).drop("rows", "row_sources")
    rows = chunks.drop("title", "units").join(facts, [doc, "logical_table_id"], "left").join(sections, [doc, "chunk_id"], "left")
    context = F.concat(
        F.array(F.col("table_title"), F.when(F.col("mode") != "compound", F.concat(F.lit("Units: "), "units")), F.when((F.size("header_context") > 0), F.concat(F.lit("Context: "), F.array_join("header_context", DASH)))),
        F.coalesce(F.transform("headers", escape), F.array().cast("array<string>")),
    )
    rows = rows.withColumn("_context", F.forall(F.array_compact(context), lambda c: F.contains(text, c))).withColumn("_table_tokens", F.when(table, F.col("n_tokens")))
    share = lambda of, ok, empty: F.round(F.coalesce(F.avg(F.when(of, ok.cast("int"))), F.lit(float(empty))), 6)
    total = lambda name: F.coalesce(F.sum(F.when(table, F.col(name))), F.lit(0))
    report = rows.groupBy(doc).agg(
        F.count(F.lit(1)).alias("chunk_count"), F.count_if(narrative).alias("narrative_chunks"), F.count_if(table).alias("table_chunks"), *distribution("n_tokens", "length"),
        share(narrative, F.regexp_like(text, F.lit(BOUNDARY)), 0).alias("boundary_accuracy"), share(F.lit(True), F.coalesce("_sections", F.lit(0)) <= 1, 1).alias("section_accuracy"),
        share(table, F.col("_context"), 1).alias("table_context_copy_completeness"), F.count_distinct(F.when(table, F.col("logical_table_id"))).alias("logical_table_count"),
        total("fragments").alias("table_fragment_count"), total("links").alias("accepted_continuation_link_count"), total("strays").alias("standalone_marker_count"),
        *distribution("empty_density", "logical_empty_density")[1:], F.count_if(F.col("empty_density") > 0.5).alias("logical_tables_over_50_percent_empty"),
        F.coalesce(F.max("_table_tokens"), F.lit(0)).alias("table_length_max"), F.count_if(F.col("_table_tokens") > size).alias("table_inputs_over_narrative_limit"),
        share(table, valid_markdown(text), 1).alias("table_markdown_validity"), F.min("chunking_config_sha256").alias("chunking_config_sha256"),
    )
    long = rows.filter(table).select(doc, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(n, F.lit("none")).alias("value")) for n in COUNTED])).alias("_of")).groupBy(doc, "_of.name", "_of.value").agg(F.count(F.lit(1)).alias("_n"))
    counts = long.groupBy(doc).agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("name") == n, F.struct("value", "_n"))))).alias(f"{n}_counts") for n in COUNTED])
    hit = used.select(doc, "block_id").distinct().withColumn("_hit", F.lit(1))
    covered = source.join(hit, [doc, "block_id"], "left")
    anchors = covered.filter("source_anchor <> ''").groupBy(doc, "source_anchor").agg(F.max("_wanted").alias("_wanted"), F.max("_hit").alias("_hit")).filter("_wanted")
    ratio = lambda name: F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias(name)
    report = report.join(counts, doc, "left").join(covered.filter("_wanted").groupBy(doc).agg(ratio("source_block_coverage")), doc, "left").join(anchors.groupBy(doc).agg(ratio("source_anchor_coverage")), doc, "left")
    report = report.join(cuts.groupBy(doc).agg(F.percentile("overlap", F.lit(0.5)).alias("actual_overlap_median")), doc, "left")
    fixed = {"strategy": config["strategy"], "length_function": config["length_function"], "chunk_size": size, "configured_overlap": config["chunk_overlap"], "chunk_schema_version": config["schema_version"], "table_schema_version": config["table_schema_version"]}
    filled = report.fillna({"source_block_coverage": 1.0, "source_anchor_coverage": 1.0, "actual_overlap_median": 0.0, "logical_empty_density_median": 0.0, "logical_empty_density_p95": 0.0, "logical_empty_density_max": 0.0})
    return filled.withColumns({k: F.lit(v) for k, v in fixed.items()})


def chunk_constraints(chunks: DataFrame, blocks: DataFrame, config: dict, doc: str = "doc") -> DataFrame:
    """(chunk_id, rule) for every constraint a chunk breaks, and under a block's id for those of its fragments.

    Beside `chunk_violations`: chunk numbers without a gap, one config, a chunk for each logical table that holds just that table's
    fragments, each once, valid Markdown; fragments and compositions as wide as they say, with a state for every cell, no blank
    cell that counts as present, and a known source block and row for every row.
    """
    table, numbered = F.col("content_type") == "table", Window.partitionBy(doc).orderBy("chunk_index")
    facts = table_facts(blocks, doc).drop("title")
    rows = chunks.select(doc, "chunk_id", "chunk_index", "content_type", "text", "block_ids", "logical_table_id", "chunking_config_sha256").withColumn("_n", F.row_number().over(numbered))
    rows = rows.withColumn("_twins", F.count(F.lit(1)).over(Window.partitionBy(doc, "logical_table_id"))).join(facts, [doc, "logical_table_id"], "left")
    if_table = lambda ok: ~table | F.col("logical_table_id").isNull() | ok
    composed = lambda ok: ~table | F.col("mode").isNull() | (F.col("mode") == "compound") | ok
    wide = (F.size("column_units") == F.col("width")) & (F.col("width") > 0) & F.forall("rows", lambda r: F.size(r) == F.col("width"))
    known = F.forall(F.flatten("row_sources"), lambda s: F.array_contains("fragment_ids", F.regexp_replace(s, ":[0-9]+$", "")))
    rules = {
        "index_gap": F.col("_n") == F.col("chunk_index"), "other_config": F.col("chunking_config_sha256") == config_sha256(config),
        "repeated_table": if_table(F.col("_twins") == 1), "unknown_table": if_table(F.col("mode").isNotNull()), "other_fragments": if_table(F.array_sort(F.array_distinct("block_ids")) == F.col("fragment_ids")),
        "invalid_markdown": ~table | valid_markdown(F.coalesce("text", F.lit(""))), "composed_width": composed(wide),
        "composed_sources": composed((F.size("row_sources") == F.size("rows")) & F.forall("row_sources", lambda s: F.size(s) > 0) & known),
    }
    found = chunk_violations(chunks, blocks, config["chunk_size"], doc).unionByName(violations(rows, "chunk_id", rules))
    spread = chunks.filter(table).select(doc, "chunk_id", F.explode("block_ids").alias("block_id"))
    again = spread.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(doc, "block_id"))).filter("_same > 1").select("chunk_id", F.lit("repeated_fragment").alias("rule")).distinct()
    size = F.col("logical_width")
    same_shape = lambda a, b: (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.size(x) == F.size(y)), lambda ok: F.coalesce(ok, F.lit(False)))
    blank = F.zip_with(F.flatten("logical_rows"), F.flatten("logical_cell_states"), lambda c, s: (c == "") & (s == "present"))
    fragment_rules = {
        "fragment_width": (size > 0) & F.forall("logical_rows", lambda r: F.size(r) == size) & (F.size("logical_column_headers") == size) & (F.size("logical_column_units") == size) & (F.size("logical_header_paths") == size) & (F.size("logical_roles") == size),
        "fragment_states": same_shape("logical_rows", "logical_cell_states"), "blank_present": ~F.exists(blank, lambda x: F.coalesce(x, F.lit(False))),
        "fragment_sources": F.size("logical_row_source_indexes") == F.size("logical_rows"), "no_source_cells": F.col("source_cells") > 0,
    }
    return found.unionByName(again).unionByName(violations(blocks.filter("logical_table_id IS NOT NULL"), "block_id", fragment_rules).withColumnRenamed("block_id", "chunk_id"))


# fixed values: where a title comes from, as reviewers count it; kinds whose empty cells count; the longest title
REVIEWED = {"none": "missing", "html_caption": "explicit", "internal_title_row": "internal", "prose_caption": "nearby", "heading": "nearby", "inherited": "inherited"}
DENSITY_KINDS = ["financial_data", "structured_text"]
LONGEST_TITLE, MOST_DENSE, DENSE_SHARE = 500, 0.5, 0.05
AUDITED = ["table_kind", "table_class", "header_mode", "title_source", "title_review", "title_quality", "continuation_rejection"]


def title_flags(title: Column) -> Column:
    """What a title gets wrong, or `accepted`; `missing` alone if there is none."""
    t = F.trim(F.coalesce(title, F.lit("")))
    whole = lambda p: F.regexp_like(t, F.lit(f"{'(?i)' if p.flags & re.IGNORECASE else ''}^(?:{p.pattern})$"))
    flags = F.array_compact(F.array(
        F.when(whole(COMPANY_HEADER), "company_header"), F.when(whole(NOTES_HEADER), "generic_notes"), F.when(whole(PAGE_LABEL), "page_label"),
        F.when(F.length(t) > LONGEST_TITLE, "overlong"), F.when(F.regexp_like(t, F.lit(f"(?i){DANGLING.pattern}")), "truncated_looking"),
    ))
    return F.when(t == "", F.array(F.lit("missing"))).when(F.size(flags) == 0, F.array(F.lit("accepted"))).otherwise(flags)


def audited(blocks: DataFrame) -> DataFrame:
    """The table blocks with what their audit asks of each: flags of the title, review bucket, rejections, complete headers, stray markers, Markdown."""
    linked = F.col("continued_from_block_id").isNotNull()
    buckets = F.create_map(*[F.lit(x) for pair in REVIEWED.items() for x in pair])
    bucket = F.coalesce(F.element_at(buckets, F.col("title_source")), F.lit("other"))
    values = F.filter(F.arrays_zip(F.col("logical_column_headers").alias("name"), F.col("logical_roles").alias("role")), lambda c: ~c["role"].eqNullSafe(F.lit("row_label")))
    return blocks.filter("logical_width IS NOT NULL").withColumns({
        "title_quality": title_flags(F.col("title")), "title_review": bucket, "table_class": F.col("content_type"),
        "continuation_rejection": F.when(linked, F.array().cast("array<string>")).otherwise(F.filter(F.coalesce("continuation_reasons", F.array().cast("array<string>")), lambda r: r != "no_previous_table")),
        "orphan": ~linked & F.regexp_like(F.coalesce("title", F.lit("")), F.lit(f"(?i){CONTINUED.pattern}")),
        "headers_complete": F.when(F.col("header_mode") != "headerless", F.forall(values, lambda c: F.coalesce(c["name"], F.lit("")) != "")),
        "counted": F.col("table_kind").isin(DENSITY_KINDS), "strays": F.size(F.filter(F.flatten("logical_rows"), lambda c: F.trim(c).isin(MARKERS))),
        "markdown": valid_markdown(F.coalesce("text", F.lit(""))),
    })


def table_audit(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """One row a filing (`corpus` false) and one of all (`corpus` true, filing null): tables and logical tables, counts by kind as
    maps, continuations, distributions of widths and densities, headers, titles, and whether few enough tables are mostly empty.

    Block ids behind a figure are rows of `table_findings`, not lists, so that the corpus row stays small. A share of nothing is 1;
    no blocks, no rows.
    """
    rows = audited(blocks)
    n = lambda condition, name: F.count_if(condition).alias(name)
    ids = lambda condition: F.count_distinct(F.when(condition, F.col("logical_table_id")))
    full = lambda of, name: F.round(F.coalesce(F.avg(of.cast("int")), F.lit(1.0)), 6).alias(name)
    untitled, dense, rejected = F.col("title_source") == "none", F.col("counted") & (F.col("logical_empty_density") > MOST_DENSE), F.size("continuation_rejection") > 0
    tables = rows.rollup(doc).agg(
        F.grouping(doc).alias("_all"), F.count(F.lit(1)).alias("table_fragments"), F.count_distinct("logical_table_id").alias("logical_tables"),
        ids(F.col("content_type").isin("data_table", "text_table", "unknown_table")).alias("included_logical_tables"), ids(F.col("content_type") == "navigation").alias("navigation_logical_tables"),
        F.count("continued_from_block_id").alias("accepted_links"), n(rejected, "rejected_pairs"), (F.count("continued_from_block_id") + F.count_if(rejected)).alias("candidate_pairs"), n(F.col("orphan"), "orphan_cues"),
        *[c for name in ("logical_width", "physical_empty_density", "logical_empty_density", "width_ratio") for c in distribution(name, name)],
        n(F.col("counted"), "density_tables"), n(dense, "dense_tables"), F.round(F.coalesce(F.count_if(dense) / F.nullif(F.count_if("counted"), F.lit(0)), F.lit(0.0)), 6).alias("dense_rate"),
        F.count("headers_complete").alias("headed_tables"), full(F.col("headers_complete"), "complete_header_rate"), F.sum("strays").alias("standalone_markers"), full(F.col("markdown"), "markdown_validity"),
        n(untitled, "missing_titles"), n(untitled & (F.col("table_kind") == "financial_data"), "missing_financial_titles"), n(F.col("table_kind") == "unknown", "unknown_tables"),
    )
    plain = lambda c: F.array(F.coalesce(c, F.lit("none")))
    values = [F.struct(F.lit(c).alias("name"), (F.col(c) if c in ("title_quality", "continuation_rejection") else plain(c)).alias("values")) for c in AUDITED]
    long = rows.select(doc, F.explode(F.array(*values)).alias("_of")).select(doc, "_of.name", F.explode("_of.values").alias("value")).groupBy(doc, "name", "value").agg(F.count(F.lit(1)).alias("_n"))
    long = long.withColumn("_all", F.lit(0)).unionByName(long.groupBy("name", "value").agg(F.sum("_n").alias("_n")).withColumns({doc: F.lit(None).cast(rows.schema[doc].dataType), "_all": F.lit(1)}))
    maps = long.groupBy(doc, "_all").agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("name") == c, F.struct("value", "_n"))))).alias(f"{c}_counts") for c in AUDITED])
    counts = blocks.rollup(doc).agg(F.grouping(doc).alias("_all"), F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("logical_width").isNull()).alias("narrative_blocks"))
    keyed = lambda df, t: df.withColumnsRenamed({doc: f"_d{t}", "_all": f"_a{t}"})
    same = lambda t: F.col(doc).eqNullSafe(F.col(f"_d{t}")) & (F.col("_all") == F.col(f"_a{t}"))
    out = counts.join(keyed(tables, 1), same(1), "left").join(keyed(maps, 2), same(2), "left").drop("_d1", "_a1", "_d2", "_a2")
    return out.withColumn("density_gate", F.coalesce(F.col("dense_rate") <= DENSE_SHARE, F.lit(True))).withColumn("corpus", F.col("_all") == 1).drop("_all")


def table_findings(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """(filing, block_id, level, rule) for each failure and warning of a table."""
    quality = lambda flag: F.array_contains("title_quality", flag)
    financial = F.col("table_kind") == "financial_data"
    rules = {
        "failure": {"standalone_marker": F.col("strays") > 0, "invalid_markdown": ~F.col("markdown"), "invalid_financial_title": financial & (quality("company_header") | quality("generic_notes") | quality("page_label"))},
        "warning": {"missing_title": F.col("title_source") == "none", "overlong_title": quality("overlong"), "unknown_kind": F.col("table_kind") == "unknown", "orphan_continued_cue": F.col("orphan"), "mostly_empty": F.col("counted") & (F.col("logical_empty_density") > MOST_DENSE)},
    }
    hits = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule"))) for level, named in rules.items() for name, rule in named.items()]))
    faults = F.transform(F.coalesce("table_faults", F.array().cast("array<string>")), lambda f: F.struct(F.lit("failure").alias("level"), f.alias("rule")))
    return audited(blocks).select(doc, "block_id", F.explode(F.concat(hits, faults)).alias("_f")).select(doc, "block_id", "_f.level", "_f.rule")
