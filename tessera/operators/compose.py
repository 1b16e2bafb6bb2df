"""Fragments of a logical table composed to one: single, vertical, horizontal or compound, in expressions over arrays.

A logical table's fragments (`html_blocks` rows with one logical_table_id) are collected in block
order; a filing's table has a handful. They are stacked if widths, header paths, contexts and
units agree; set side by side if labels are unique, overlap by 0.8 or more from one to the next
and no header path occurs twice; else each is rendered by itself. Every row says which fragment
and source row it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import canonical

LABEL_OVERLAP = 0.8
PARTS = ["block_index", "block_id", "title", "units", "logical_width", "logical_header_paths", "logical_header_context", "logical_column_headers", "logical_column_units", "logical_roles", "logical_rows", "logical_row_roles", "logical_row_source_indexes"]
DASH = " — "


def row_labels(rows: Column) -> Column:
    """The rows' first cells as they are compared, empty ones too."""
    return F.transform(rows, lambda r: canonical(F.get(r, 0)))


def full_paths(fragment: Column) -> Column:
    """Header paths below their context; the label column has none."""
    return F.transform(fragment["logical_header_paths"], lambda p, i: F.when(i == 0, p).otherwise(F.concat(fragment["logical_header_context"], p)))


def label_overlap(a: Column, b: Column) -> Column:
    """Shared labels over the fewer labels of two fragments; 0 if one has none."""
    x, y = (F.array_distinct(F.filter(row_labels(f["logical_rows"]), lambda v: v != "")) for f in (a, b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def vertical_fits(fragments: Column) -> Column:
    alike = F.transform(fragments, lambda f: F.struct(f["logical_width"], f["logical_header_paths"], f["logical_header_context"], f["logical_column_units"]))
    return (F.size(fragments) > 1) & (F.size(F.array_distinct(alike)) == 1)


def horizontal_fits(fragments: Column) -> Column:
    labels = lambda f: F.filter(row_labels(f["logical_rows"]), lambda v: v != "")
    unique = F.forall(fragments, lambda f: (f["logical_width"] >= 2) & (F.size(labels(f)) == F.size(F.array_distinct(labels(f)))))
    near = F.forall(F.sequence(F.lit(0), F.size(fragments) - 2), lambda i: label_overlap(F.get(fragments, i), F.get(fragments, i + 1)) >= LABEL_OVERLAP)
    lower = lambda f: F.array_distinct(F.transform(F.filter(F.slice(full_paths(f), 2, F.greatest(F.lit(0), f["logical_width"] - 1)), lambda p: F.size(p) > 0), lambda p: F.lower(F.array_join(p, "\n"))))
    paths = F.transform(fragments, lower)
    apart = F.forall(paths, lambda p: F.size(p) > 0) & (F.size(F.flatten(paths)) == F.size(F.array_distinct(F.flatten(paths))))
    return (F.size(fragments) > 1) & unique & F.when(F.size(fragments) > 1, near).otherwise(False) & apart


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def display_headers(headers: Column, roles: Column) -> Column:
    """Column names for display: "Row label" or "Value n" where there is none, "(n)" from the second of equal names on."""
    n = lambda i: F.size(F.filter(F.slice(F.arrays_zip(headers.alias("h"), roles.alias("r")), 1, i + 1), lambda x: (x["h"] == "") & (x["r"] != "row_label")))
    named = F.transform(headers, lambda h, i: F.when(h != "", h).when(F.get(roles, i) == "row_label", "Row label").otherwise(F.concat(F.lit("Value "), n(i).cast("string"))))
    again = lambda names: F.transform(names, lambda h, i: F.size(F.filter(F.slice(names, 1, i + 1), lambda x: x == h)))
    return F.zip_with(named, again(named), lambda h, k: F.when(k == 1, h).otherwise(F.concat(h, F.lit(" ("), k.cast("string"), F.lit(")"))))


def render(title: Column, summary: Column, context: Column, headers: Column, roles: Column, units: Column, rows: Column) -> Column:
    """Title, units and context, then the table with number columns aligned right."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.array_compact(F.array(title, F.concat(F.lit("Units: "), summary), F.when(F.size(context) > 0, F.concat(F.lit("Context: "), F.array_join(context, DASH)))))
    rules = F.transform(units, lambda u: F.when(u.isin("text", "unknown", "date"), "---").otherwise("---:"))
    body = F.concat(F.array(line(F.transform(display_headers(headers, roles), escape)), line(rules)), F.transform(rows, lambda r: line(F.transform(r, escape))))
    return F.array_join(F.concat(head, F.when(F.size(head) > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), body), "\n")


def compose_tables(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, logical_table_id, mode, fragments, block_ids, title, width, headers, units, header_context, rows, row_roles, row_sources, text) for each logical table."""
    rows = blocks.filter("logical_table_id IS NOT NULL").select(F.col(doc).alias("doc"), "logical_table_id", F.struct(*PARTS).alias("f"))
    got = rows.groupBy("doc", "logical_table_id").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    fs, first = F.col("fs"), F.get("fs", 0)
    mode = F.when(F.size(fs) == 1, "single").when(vertical_fits(fs), "vertical").when(horizontal_fits(fs), "horizontal").otherwise("compound")
    got = got.withColumn("mode", mode).withColumn("labels", F.array_distinct(F.flatten(F.transform(fs, lambda f: row_labels(f["logical_rows"])))))
    with_label = lambda f, k: F.filter(F.arrays_zip(f["logical_rows"].alias("cells"), f["logical_row_roles"].alias("role"), f["logical_row_source_indexes"].alias("at")), lambda r: canonical(F.get(r["cells"], 0)) == k)
    rest = lambda f, k: F.when(F.size(with_label(f, k)) > 0, F.slice(F.element_at(with_label(f, k), -1)["cells"], 2, f["logical_width"] - 1)).otherwise(F.array_repeat(F.lit(""), f["logical_width"] - 1))
    every = lambda k: F.flatten(F.transform(fs, lambda f: with_label(f, k)))
    wide = F.transform("labels", lambda k: F.concat(F.array(F.get(F.get(every(k), 0)["cells"], 0)), F.flatten(F.transform(fs, lambda f: rest(f, k)))))
    wide_roles = F.transform("labels", lambda k: F.element_at(every(k), -1)["role"])
    wide_sources = F.transform("labels", lambda k: F.flatten(F.transform(fs, lambda f: F.transform(with_label(f, k), lambda r: F.concat_ws(":", f["block_id"], r["at"])))))
    tail = lambda f, of: F.slice(of, 2, F.greatest(F.lit(0), f["logical_width"] - 1))
    path_names = lambda f: F.zip_with(tail(f, full_paths(f)), tail(f, f["logical_column_headers"]), lambda p, h: F.when(F.size(p) > 0, F.array_join(p, DASH)).otherwise(h))
    wide_headers = F.concat(F.array(F.when(F.get(first["logical_column_headers"], 0) != "", F.get(first["logical_column_headers"], 0)).otherwise("Line item")), F.flatten(F.transform(fs, path_names)))
    beside = lambda name: F.concat(F.array(F.get(first[name], 0)), F.flatten(F.transform(fs, lambda f: tail(f, f[name]))))
    stacked = lambda name: F.flatten(F.transform(fs, lambda f: f[name]))
    stacked_sources = F.flatten(F.transform(fs, lambda f: F.transform(f["logical_row_source_indexes"], lambda at: F.array(F.concat_ws(":", f["block_id"], at)))))
    by_mode = lambda tall, broad: F.when(F.col("mode") == "horizontal", broad).when(F.col("mode") != "compound", tall)
    out = got.select(
        "doc", "logical_table_id", "mode", "fs",
        by_mode(first["logical_column_headers"], wide_headers).alias("headers"), by_mode(first["logical_column_units"], beside("logical_column_units")).alias("units"),
        by_mode(first["logical_roles"], beside("logical_roles")).alias("roles"), by_mode(first["logical_header_context"], F.array().cast("array<string>")).alias("header_context"),
        by_mode(stacked("logical_rows"), wide).alias("rows"), by_mode(stacked("logical_row_roles"), wide_roles).alias("row_roles"), by_mode(stacked_sources, wide_sources).alias("row_sources"),
    )
    nothing = F.lit(None).cast("string")
    alone = lambda f: render(nothing, f["units"], f["logical_header_context"], f["logical_column_headers"], f["logical_roles"], f["logical_column_units"], f["logical_rows"])
    apart = F.array_join(F.transform(fs, lambda f, i: F.concat(F.lit("Fragment "), (i + 1).cast("string"), F.lit("\n\n"), alone(f))), "\n\n")
    compound = F.concat(F.coalesce(F.concat(first["title"], F.lit("\n\n")), F.lit("")), apart)
    whole = render(first["title"], first["units"], F.col("header_context"), F.col("headers"), F.col("roles"), F.col("units"), F.col("rows"))
    return out.select(
        "doc", "logical_table_id", "mode", F.size(fs).alias("fragments"), F.transform(fs, lambda f: f["block_id"]).alias("block_ids"), first["title"].alias("title"),
        F.size("headers").alias("width"), "headers", "units", "header_context", "rows", "row_roles", "row_sources", F.when(F.col("mode") == "compound", compound).otherwise(whole).alias("text"),
    )
