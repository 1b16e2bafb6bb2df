"""Filings rendered from customers and their orders, read back by the block walk and the table engine.

Every customer files one HTML page with headings, hidden parts, page furniture, lists and tables of
all kinds; what the engine must find in it follows from the tables, so SQL can say it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.jobs import CONFIG
from tessera.operators import audit, chunker, compose, html
from tessera.sources.store import once, stored, version
from tessera.sources.tables import table

YEARS = (1996, 1995)
STATUS = [("F", "Filled"), ("O", "Open"), ("P", "Pending")]
PRIORITY = [("1-URGENT", "Urgent"), ("2-HIGH", "High")]


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """A row a customer: order counts and whole values by year, status and priority."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"), "o_orderstatus", "o_orderpriority", F.floor("o_totalprice").cast("long").alias("v"))
    per_year = lambda y: [
        F.sum(F.when(F.col("y") == y, F.col("v"))).alias(f"value{y}"), F.max(F.when(F.col("y") == y, F.col("v"))).alias(f"largest{y}"),
        *[F.sum(F.when((F.col("y") == y) & (F.col("o_orderstatus") == s), F.col("v") + 1000)).alias(f"status{s}{y}") for s, _ in STATUS],
        *[F.count_if((F.col("y") == y) & (F.col("o_orderpriority") == p)).alias(f"n{p[0]}{y}") for p, _ in PRIORITY],
        *[F.sum(F.when((F.col("y") == y) & (F.col("o_orderpriority") == p), F.col("v"))).alias(f"v{p[0]}{y}") for p, _ in PRIORITY],
    ]
    sums = orders.groupBy("c_custkey").agg(*per_year(YEARS[0]), *per_year(YEARS[1]), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("o_orderstatus") == s).alias(f"n{s}") for s, _ in STATUS])
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(nation, "c_nationkey").join(sums, "c_custkey", "left")


def shown(name: str) -> Column:
    """A whole number with commas, a dash for none."""
    c = F.col(name)
    return F.when(F.coalesce(c, F.lit(0)) == 0, "—").otherwise(F.format_number(c, 0))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _row(*cells: str | Column) -> Column:
    return _text("<tr>", *[c if isinstance(c, str) and c.startswith("<t") else _text("<td>", c, "</td>") for c in cells], "</tr>")


def _table(*rows: Column) -> Column:
    return _text("<table>", *rows, "</table>")


def _head(text: str, span: int) -> str:
    return f'<td colspan="{span}" style="text-align: center"><b>{text}</b></td>'


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, html) of every customer."""
    a, b = YEARS
    year_heads = [_row("", _head("Year ended December 31,", 4)), _row("", _head(str(a), 2), _head(str(b), 2))]
    share = lambda s: F.when(F.coalesce(F.col(f"n{s}"), F.lit(0)) == 0, "—").otherwise(F.concat(F.floor(100 * F.col(f"n{s}") / F.col("n")).cast("string"), F.lit("%")))
    by_priority = lambda y: _table(
        _row("", _head(f"As of December 31, {y}", 4)), _row("", _head("Orders", 2), _head("Value", 2)),
        *[_row(name, "", shown(f"n{p[0]}{y}"), "$", shown(f"v{p[0]}{y}")) for p, name in PRIORITY],
    )
    page = _text(
        "<html><head><title>x</title><style>p {color: red}</style></head><body><p>", F.col("c_name"), " annual report</p>",
        _table(_row("Business", "1"), _row("Risk Factors", "12"), _row("Properties", "30")),
        '<p><a href="#i1"><b>Item 1. Business</b></a></p><p id="i1"><b>Item 1. Business</b></p><p>', F.col("c_name"), " serves the <b>", F.col("c_mktsegment"),
        '</b> segment co-<br>operatively with soft&shy;<br>ware &amp; more<span style="display: none">hidden</span>.</p><script>var x = "<p>no</p>"</script>',
        '<div><i>Plain</i> name of <ix:nonNumeric name="dei:EntityRegistrantName">', F.col("c_name"), '</ix:nonNumeric></div><hr style="page-break-after: always">',
        '<p style="text-align:center; margin:24pt 0pt 0pt 0pt">', (F.col("c_custkey") % 100).cast("string"), '</p><p><a href="#toc">Table of Contents</a></p>',
        "<ul><li>Market<ul><li>Nation ", F.col("n_name"), "</li></ul></li><li>Balance</li></ul>",
        _table(_row("•", "First point"), _row("", "goes on"), _row("•", _text("Point of ", F.col("n_name")))),
        '<p id="i8"><b>Item 8. Financial Statements</b></p><p>Status is counted. The following table summarizes the status of orders:</p>',
        _table(_row("<th>Status</th>", "<th>Percent of orders</th>"), *[_row(name, share(s)) for s, name in STATUS]),
        "<p><b>Order values</b></p>",
        _table(*year_heads, _row("Order value", "$", shown(f"value{a}"), "$", shown(f"value{b}")), _row("Largest order", "", shown(f"largest{a}"), "", shown(f"largest{b}")), _row("Total cash", "$", shown(f"value{a}"), "$", shown(f"value{b}"))),
        _table(*year_heads, *[_row(f"{name} orders", "", shown(f"status{s}{a}"), "", shown(f"status{s}{b}")) for s, name in STATUS]),
        "<p>Orders by priority are below.</p>", by_priority(a), by_priority(b), "<p>Regions are below.</p>",
        _table(_row("<th>Region</th>", "<th>Customers</th>"), _row(F.col("n_name"), F.col("c_custkey").cast("string")), _row("Elsewhere", "7")),
        _table(_row("<th>Region</th>", "<th>Suppliers</th>"), _row(_text(F.col("n_name"), " (continued)"), "11"), _row("Nowhere", "12")),
        "<p><b>Exhibits</b></p>", _table(_row("<th>Exhibit No.</th>", "<th>Description</th>"), _row(_text("10.", F.col("c_nationkey").cast("string")), _text("Form of agreement with ", F.col("n_name"))), _row("21.1", _text("List of orders of ", F.col("c_name")))),
        "<p><b>SIGNATURES</b></p>", _table(_row(_text("/s/ ", F.col("c_name"))), _row("Principal Executive Officer")), "</body></html>",
    )
    # pages cost far more to read than to make, so their facts are dealt evenly, whatever the joins left, and each is made where it is read
    dealt = facts(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return dealt.select(F.col("c_custkey").alias("page_id"), page.alias("html"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks of all filings, read once a Spark application and again if the tables change."""
    made_from = tuple(version(spark, f"{sf}/{n}.parquet") for n in ("customer", "nation", "orders"))
    return once(spark, ("filings", sf, made_from), lambda: stored(html.html_blocks(pages(spark, sf), whole_body=False), "filing-blocks"))


joined = lambda name, by="|": F.array_join(name, by)
lines = lambda name: F.array_join(F.transform(name, lambda r: F.array_join(r, "|")), "\n")


def filing_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaning, the walk, headings, sections, regions, lists, anchors and the text of every block."""
    return blocks(spark, sf).select("doc", "block_index", "block_id", "content_type", "source_tag", "source_anchor", "heading_kind", "section", "document_region", joined("effective_section_path", "/").alias("path"), "text")


def filing_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Grid, headers, lanes, values, units, titles, kinds, continuation and quality of every table."""
    return blocks(spark, sf).filter("logical_width IS NOT NULL").select(
        "doc", "block_index", "table_kind", "title", "title_source", "units", "header_mode", "logical_width", joined("logical_column_headers").alias("headers"), joined("logical_column_units").alias("column_units"),
        joined("logical_header_context").alias("context"), lines("logical_header_paths").alias("paths"), joined("logical_roles").alias("roles"), lines("logical_rows").alias("rows"), joined("logical_row_roles").alias("row_roles"),
        joined(F.transform("logical_row_source_indexes", lambda x: x.cast("string"))).alias("source_rows"), joined("table_reasons").alias("reasons"), "continued_from_block_id", joined("continuation_reasons").alias("continuation"),
        joined("inherited_fields").alias("inherited"), joined("table_faults").alias("faults"), "source_cells", F.round("physical_empty_density", 6).alias("physical_empty_density"), "logical_empty_density",
        F.round("width_ratio", 6).alias("width_ratio"), F.round("accounted", 6).alias("accounted"), "html_table_id", "html_table_xpath",
    )


def filing_compositions(spark: SparkSession, sf: str) -> DataFrame:
    """Logical tables composed of their fragments, and their text."""
    found = compose.compose_tables(blocks(spark, sf))
    return found.select("doc", "logical_table_id", "mode", "fragments", joined("block_ids").alias("block_ids"), "title", joined("headers").alias("headers"), joined("units").alias("units"), joined("header_context").alias("context"), lines("rows").alias("rows"), joined("row_roles").alias("row_roles"), lines("row_sources").alias("row_sources"), "text")


def filing_cell_states(spark: SparkSession, sf: str) -> DataFrame:
    """What each value cell of the tables is: present, a missing marker, or blank; counted a table."""
    states = blocks(spark, sf).filter("logical_width IS NOT NULL").select("doc", "block_index", F.explode(F.flatten("logical_cell_states")).alias("state"))
    return states.groupBy("doc", "block_index", "state").agg(F.count(F.lit(1)).alias("cells"))


def filing_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Inline XBRL facts of every page."""
    return html.filing_facts(pages(spark, sf))


def nation_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A page a region whose table spans rows and columns: the place of every source cell."""
    nations = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    line = lambda n, i: _text(
        "<tr>", F.when(i == 0, _text('<th rowspan="', F.size("ns").cast("string"), '">Region ', F.col("n_regionkey").cast("string"), "</th>")).otherwise(""),
        "<td>", n["n_name"], '</td><td align="center" colspan="x">', F.format_number(n["n_nationkey"] * 1000, 0), '</td><td style="border-bottom: 1pt solid black"><table><tr><td>inner</td></tr></table></td></tr>',
    )
    head = '<html><body><table><thead><tr><th colspan="2"><b>Place</b> of <b>x</b></th><th colspan="0">Code</th><th>Nested</th></tr></thead><tbody>'
    page = _text(head, F.array_join(F.transform("ns", line), ""), "</tbody></table></body></html>")
    return html.source_cells(nations.select(F.col("n_regionkey").cast("long").alias("page_id"), page.alias("html")))


def filing_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Narrative runs and composed tables as chunks of the production size."""
    found = chunker.chunk_blocks(blocks(spark, sf), CONFIG)
    return found.select("doc", "chunk_id", "chunk_index", "content_type", "section", "text", joined("block_ids").alias("block_ids"), "source_text_start", "source_text_end", "logical_table_id", "composition_mode", "title")


def filing_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Block counts, table kinds, title sources, densities and continuations of every filing and of all."""
    return audit.filing_report(blocks(spark, sf))


def filing_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of the filings damaged by rule, and how often each constraint finds it."""
    b = blocks(spark, sf)
    at = lambda n, k: (F.col("doc") % 13 == n) & (F.col("block_index") == k)
    damaged = b.filter(~at(1, 5)).withColumn("text", F.when(at(2, 3), " ").otherwise(F.col("text"))).withColumn("block_id", F.when(at(3, 7), F.lit("twice")).otherwise(F.col("block_id")))
    damaged = damaged.withColumn("continued_from_block_id", F.when(at(4, 14), F.lit("nowhere")).otherwise(F.col("continued_from_block_id"))).withColumn("logical_rows", F.when(at(5, 13), F.transform("logical_rows", lambda r, i: F.when(i == 0, F.slice(r, 1, 1)).otherwise(r))).otherwise(F.col("logical_rows")))
    damaged = damaged.withColumn("logical_row_roles", F.when(at(6, 13), F.slice("logical_row_roles", 1, 1)).otherwise(F.col("logical_row_roles")))
    return audit.block_violations(damaged).groupBy("rule").agg(F.count(F.lit(1)).alias("blocks"))


QUERIES = {f.__name__: f for f in (filing_chunks, filing_audit, filing_violations, filing_blocks, filing_tables, filing_compositions, filing_cell_states, filing_facts, nation_grid)}

# What the engine must read from the pages: templates, filled from the tables. {x} stands for a value of the customer.
_A, _B = YEARS
_ITEM1, _ITEM8 = "Item 1 — Business", "Item 8 — Financial Statements"
_P = "paragraph"
_STATUS_TEXT = "The following table summarizes the status of orders"
_S_ROWS = [["Filled", "{pF}"], ["Open", "{pO}"], ["Pending", "{pP}"]]
_F1_ROWS = [["Order value", f"${{value{_A}}}", f"${{value{_B}}}"], ["Largest order", f"{{largest{_A}}}", f"{{largest{_B}}}"], ["Total cash", f"${{value{_A}}}", f"${{value{_B}}}"]]
_F2_ROWS = [[f"{name} orders", f"{{status{s}{_A}}}", f"{{status{s}{_B}}}"] for s, name in STATUS]
_G_ROWS = {y: [[name, f"{{n{p[0]}{y}}}", f"${{v{p[0]}{y}}}"] for p, name in PRIORITY] for y in YEARS}
_C1_ROWS, _C2_ROWS = [["{nation}", "{key}"], ["Elsewhere", "7"]], [["{nation} (continued)", "11"], ["Nowhere", "12"]]
_X_ROWS = [["10.{nk}", "Form of agreement with {nation}"], ["21.1", "List of orders of {name}"]]
_YEAR = "Year ended December 31,"


def _md(rows: list[list[str]], headers: list[str], right: list[bool], head: tuple[str, ...] = ()) -> str:
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([*head, *([""] if head else []), line(headers), line(["---:" if x else "---" for x in right]), *map(line, rows)])


_TEXTS = {
    "S": _md(_S_ROWS, ["Status", "Percent of orders"], [False, True], (_STATUS_TEXT, "Units: percent")),
    "F1": _md(_F1_ROWS, ["Line item", str(_A), str(_B)], [False, True, True], ("Order values", "Units: usd", f"Context: {_YEAR}")),
    "F2": _md(_F2_ROWS, ["Line item", str(_A), str(_B)], [False, True, True], ("Order values", "Units: usd", f"Context: {_YEAR}")),
    **{f"G{y}": _md(_G_ROWS[y], ["Line item", "Orders", "Value"], [False, True, True], ("Units: usd", f"Context: As of December 31, {y}")) for y in YEARS},
    "C1": _md(_C1_ROWS, ["Region", "Customers"], [False, True]), "C2": _md(_C2_ROWS, ["Region", "Suppliers"], [False, True]),
    "X": _md(_X_ROWS, ["Exhibit No.", "Description"], [False, False], ("Exhibits",)),
    "N": _md([["Principal Executive Officer"]], ["Row label"], [False], ("/s/ {name}",)),
}
_FIN, _OV = "financial_statements", f"{_ITEM8}/Order values"
_BLOCKS = [  # content type, tag, anchor, heading kind, section, region, path, text
    ("heading", "p", "i1", "item", _ITEM1, "filing_body", _ITEM1, "Item 1. Business"),
    (_P, "p", "i1", None, _ITEM1, "filing_body", _ITEM1, "{name} serves the {seg} segment co-operatively with software & more."),
    (_P, "div", "i1", None, _ITEM1, "filing_body", _ITEM1, "Plain name of {name}"),
    *[("list_item", tag, "i1", None, _ITEM1, "filing_body", _ITEM1, x) for tag, x in (("li", "Market"), ("li", "Nation {nation}"), ("li", "Balance"), ("table", "First point goes on"), ("table", "Point of {nation}"))],
    ("heading", "p", "i8", "item", _ITEM8, _FIN, _ITEM8, "Item 8. Financial Statements"),
    (_P, "p", "i8", None, _ITEM8, _FIN, _ITEM8, f"Status is counted. {_STATUS_TEXT}:"),
    ("data_table", "table", "i8", None, _ITEM8, _FIN, _ITEM8, _TEXTS["S"]),
    ("heading", "p", "i8", "subsection", _ITEM8, _FIN, _OV, "Order values"),
    *[("data_table", "table", "i8", None, _ITEM8, _FIN, _OV, _TEXTS[x]) for x in ("F1", "F2")],
    (_P, "p", "i8", None, _ITEM8, _FIN, _OV, "Orders by priority are below."),
    *[("data_table", "table", "i8", None, _ITEM8, _FIN, _OV, _TEXTS[f"G{y}"]) for y in YEARS],
    (_P, "p", "i8", None, _ITEM8, _FIN, _OV, "Regions are below."),
    *[("text_table", "table", "i8", None, _ITEM8, _FIN, _OV, _TEXTS[x]) for x in ("C1", "C2")],
    ("heading", "p", "i8", "subsection", _ITEM8, "exhibits", f"{_ITEM8}/Exhibits", "Exhibits"),
    ("text_table", "table", "i8", None, _ITEM8, "exhibits", f"{_ITEM8}/Exhibits", _TEXTS["X"]),
    ("heading", "p", "i8", "subsection", _ITEM8, "signatures", f"{_ITEM8}/SIGNATURES", "SIGNATURES"),
    ("text_table", "table", "i8", None, _ITEM8, "signatures", f"{_ITEM8}/SIGNATURES", _TEXTS["N"]),
]
_BAR = "|".join
_GRID_REASON, _LINE = "repeated_record_grid", "Line item"


def _rows(rows: list[list[str]]) -> str:
    return "\n".join(map(_BAR, rows))


def _tbl(index: int, number: int, kind: str, title: str | None, source: str, units: str | None, mode: str, headers: list[str], column_units: list[str], context: str, roles: list[str], rows: list[list[str]], row_roles: str, first: int, reasons: list[str], before: int | None, why: list[str], taken: list[str], cells: int, empty: float, ratio: float, accounted: float) -> tuple:
    paths = _rows([[] if h == _LINE or not h else [h] for h in headers])
    return (
        index, kind, title, source, units, mode, len(headers), _BAR(headers), _BAR(column_units), context, paths, _BAR(roles), _rows(rows), row_roles, _BAR(str(first + k) for k in range(len(rows))), _BAR(reasons),
        f"{{key}}-0-{before:06d}" if before else None, _BAR(why), _BAR(taken), "", cells, round(empty, 6), 0.0, round(ratio, 6), round(accounted, 6), f"{{key}}-0-HTMLTABLE-{number:04d}", f"/html/body/table[{number}]",
    )


_VALUE3 = ["row_label", "value", "value"]
_TABLES = [
    _tbl(11, 3, "financial_data", _STATUS_TEXT, "prose_caption", "percent", "explicit", ["Status", "Percent of orders"], ["text", "percent"], "", ["row_label", "{rS}"], _S_ROWS, "data|data|data", 1, ["financial_region{rC}", "scale_currency_evidence", _GRID_REASON], None, ["no_previous_table"], [], 8, 0, 1, 6 / 8),
    _tbl(13, 4, "financial_data", "Order values", "heading", "usd", "inferred", [_LINE, str(_A), str(_B)], ["text", "usd", "usd"], _YEAR, _VALUE3, _F1_ROWS, "data|data|total", 2, ["financial_region", "financial_terms", "currency_values", "scale_currency_evidence", "period_headers", _GRID_REASON], None, ["intervening_semantic_content", "conflicting_explicit_title", "native_unit_conflict"], [], 16, 9 / 25, 3 / 5, 13 / 16),
    _tbl(14, 5, "financial_data", "Order values", "inherited", "usd", "inferred", [_LINE, str(_A), str(_B)], ["text", "usd", "usd"], _YEAR, _VALUE3, _F2_ROWS, "data|data|data", 2, ["financial_region", "scale_currency_evidence", "period_headers", _GRID_REASON], 13, ["repeated_headers_with_complementary_rows"], ["title", "units"], 12, 13 / 25, 3 / 5, 9 / 12),
    *[
        _tbl(16 + k, 6 + k, "financial_data", None, "none", "usd", "inferred", [_LINE, "Orders", "Value"], ["text", "number", "usd"], f"As of December 31, {y}", _VALUE3, _G_ROWS[y], "data|data", 2, ["financial_region", "currency_values", "scale_currency_evidence", _GRID_REASON], 16 if k else None, ["row_label_overlap_with_different_period" if k else "intervening_semantic_content"], [], 11, 9 / 20, 3 / 5, 8 / 11)
        for k, y in enumerate(YEARS)
    ],
    _tbl(19, 8, "structured_text", None, "none", None, "explicit", ["Region", "Customers"], ["text", "number"], "", ["row_label", "value"], _C1_ROWS, "data|data", 1, [_GRID_REASON], None, ["intervening_semantic_content", "table_kind_family_conflict"], [], 6, 0, 1, 4 / 6),
    _tbl(20, 9, "structured_text", None, "none", None, "explicit", ["Region", "Suppliers"], ["text", "number"], "", ["row_label", "value"], _C2_ROWS, "data|data", 1, [_GRID_REASON], 19, ["explicit_continued_cue"], [], 6, 0, 1, 4 / 6),
    _tbl(22, 10, "exhibit_list", "Exhibits", "heading", None, "explicit", ["Exhibit No.", "Description"], ["text", "text"], "", ["row_label", "text"], _X_ROWS, "data|data", 1, ["exhibit_headers"], None, ["intervening_semantic_content", "document_region_conflict", "table_kind_family_conflict"], [], 6, 0, 1, 4 / 6),
    _tbl(24, 11, "layout", "/s/ {name}", "internal_title_row", None, "headerless", [""], ["text"], "", ["row_label"], [["Principal Executive Officer"]], "section_label", 1, ["signature_layout"], None, ["intervening_semantic_content", "document_region_conflict", "conflicting_explicit_title", "table_kind_family_conflict"], [], 2, 0, 1, 1 / 2),
]


def _composed(number: int, mode: str, ids: list[int], title: str | None, headers: list[str] | None, units: list[str] | None, context: str | None, rows: list[list[str]] | None, row_roles: str | None, sources: list[list[tuple[int, int]]] | None, text: str) -> tuple:
    name = lambda k: f"{{key}}-0-{k:06d}"
    return (
        f"{{key}}-0-TABLE-{number:04d}", mode, len(ids), _BAR(map(name, ids)), title, headers and _BAR(headers), units and _BAR(units), context, rows and _rows(rows), row_roles,
        sources and _rows([[f"{name(b)}:{r}" for b, r in row] for row in sources]), text,
    )


_WIDE = [_LINE, *[f"As of December 31, {y} — {c}" for y in YEARS for c in ("Orders", "Value")]]
_WIDE_ROWS = [[_G_ROWS[_A][k][0], *_G_ROWS[_A][k][1:], *_G_ROWS[_B][k][1:]] for k in range(2)]
_COMPOSED = [
    _composed(3, "single", [11], _STATUS_TEXT, ["Status", "Percent of orders"], ["text", "percent"], "", _S_ROWS, "data|data|data", [[(11, r)] for r in (1, 2, 3)], _TEXTS["S"]),
    _composed(4, "vertical", [13, 14], "Order values", [_LINE, str(_A), str(_B)], ["text", "usd", "usd"], _YEAR, _F1_ROWS + _F2_ROWS, "data|data|total|data|data|data", [[(b, r)] for b in (13, 14) for r in (2, 3, 4)], _md(_F1_ROWS + _F2_ROWS, [_LINE, str(_A), str(_B)], [False, True, True], ("Order values", "Units: usd", f"Context: {_YEAR}"))),
    _composed(6, "horizontal", [16, 17], None, _WIDE, ["text", "number", "usd", "number", "usd"], "", _WIDE_ROWS, "data|data", [[(16, r), (17, r)] for r in (2, 3)], _md(_WIDE_ROWS, _WIDE, [False] + [True] * 4, ("Units: usd",))),
    _composed(8, "compound", [19, 20], None, None, None, None, None, None, None, f"Fragment 1\n\n{_TEXTS['C1']}\n\nFragment 2\n\n{_TEXTS['C2']}"),
    _composed(10, "single", [22], "Exhibits", ["Exhibit No.", "Description"], ["text", "text"], "", _X_ROWS, "data|data", [[(22, r)] for r in (1, 2)], _TEXTS["X"]),
    _composed(11, "single", [24], "/s/ {name}", [""], ["text"], "", [["Principal Executive Officer"]], "section_label", [[(24, 1)]], _TEXTS["N"]),
]


def _facts_sql() -> str:
    sums = []
    for y in YEARS:
        sums += [f"sum(v) FILTER (y = {y}) AS value{y}", f"max(v) FILTER (y = {y}) AS largest{y}"]
        sums += [f"sum(v + 1000) FILTER (y = {y} AND s = '{s}') AS status{s}{y}" for s, _ in STATUS]
        sums += [f"count(*) FILTER (y = {y} AND p = '{p}') AS n{p[0]}{y}, sum(v) FILTER (y = {y} AND p = '{p}') AS v{p[0]}{y}" for p, _ in PRIORITY]
    return f"""o AS (SELECT o_custkey AS k, year(o_orderdate) AS y, o_orderstatus AS s, o_orderpriority AS p, floor(o_totalprice)::BIGINT AS v FROM orders),
s AS (SELECT k, count(*) AS n, {", ".join(f"count(*) FILTER (s = '{s}') AS n{s}" for s, _ in STATUS)}, {", ".join(sums)} FROM o GROUP BY k),
f AS (SELECT c_custkey AS doc, c_name, c_mktsegment, n_name, c_nationkey, s.* FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s ON k = c_custkey)"""


def _filled(column: str) -> str:
    """The column with every {x} replaced by the customer's value."""
    values = {"name": "c_name", "seg": "c_mktsegment", "nation": "n_name", "key": "doc::VARCHAR", "nk": "c_nationkey::VARCHAR"}
    for s, _ in STATUS:
        values[f"p{s}"] = f"CASE WHEN coalesce(n{s}, 0) = 0 THEN '—' ELSE floor(100 * n{s} / n)::BIGINT || '%' END"
    values["rS"] = "CASE WHEN coalesce(n, 0) = 0 THEN 'value' ELSE 'percent' END"
    values["rC"] = "CASE WHEN coalesce(n, 0) = 0 THEN '' ELSE '|currency_values' END"
    for y in YEARS:
        for name in (f"value{y}", f"largest{y}", *[f"status{s}{y}" for s, _ in STATUS], *[f"{c}{p[0]}{y}" for c in "nv" for p, _ in PRIORITY]):
            values[name] = f"CASE WHEN coalesce({name}, 0) = 0 THEN '—' ELSE format('{{:,}}', {name}::BIGINT) END"
            if name[0] in "nv" and name[1] in "12":
                values["kind" + name] = f"CASE WHEN coalesce({name}, 0) = 0 THEN 'missing_numeric' ELSE 'numeric_scalar' END"
    out = column
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


def _from_templates(rows: list[tuple], names: list[str]) -> str:
    literal = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    texts = {n for k, n in enumerate(names) if any(isinstance(r[k], str) and "{" in r[k] for r in rows)}
    columns = ", ".join(f"{_filled('t.' + n)} AS {n}" if n in texts else f"t.{n}" for n in names)
    return f"WITH {_facts_sql()} SELECT doc, {columns} FROM f, (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({', '.join(names)})"


_TABLE_NAMES = "block_index table_kind title title_source units header_mode logical_width headers column_units context paths roles rows row_roles source_rows reasons continued_from_block_id continuation inherited faults source_cells physical_empty_density logical_empty_density width_ratio accounted html_table_id html_table_xpath".split()


def _states_sql() -> str:
    """Cells that show a value of the customer are missing markers where it is 0; all others are present."""
    dashes = {11: [f"n{s}" for s, _ in STATUS], 13: [f"{c}{y}" for y in YEARS for c in ("value", "largest", "value")], 14: [f"status{s}{y}" for y in YEARS for s, _ in STATUS], **{16 + k: [f"{c}{p[0]}{y}" for c in "nv" for p, _ in PRIORITY] for k, y in enumerate(YEARS)}}
    fixed = {11: 3, 13: 3, 14: 3, 16: 2, 17: 2, 19: 4, 20: 4, 22: 4}
    parts = [f"SELECT doc, {i} AS block_index, {' + '.join(f'(coalesce({v}, 0) = 0)::INT' for v in dashes[i])} AS missing, {fixed[i] + len(dashes[i])} AS all_cells FROM f" if i in dashes else f"SELECT doc, {i}, 0, {n} FROM f" for i, n in fixed.items()]
    return f"""WITH {_facts_sql()}, c AS ({" UNION ALL ".join(parts)})
SELECT doc, block_index, 'present' AS state, (all_cells - missing)::BIGINT AS cells FROM c WHERE all_cells > missing
UNION ALL SELECT doc, block_index, 'missing_marker', missing::BIGINT FROM c WHERE missing > 0 UNION ALL SELECT doc, 24, 'present', 1 FROM f"""


def _chunks() -> list[tuple]:
    """Runs of narrative blocks of one path as one chunk each (they are short), tables by their logical id, in order."""
    out: list[tuple] = []
    tables = {k: c for c, first in ((c, int(c[3].split("|")[0][-6:])) for c in _COMPOSED) for k in [first]}
    runs: list[tuple[str, str, list[int]]] = []
    for k, (kind, _, _, _, section, _, path, _) in enumerate(_BLOCKS, 1):
        if kind.endswith("table"):
            if k in tables:
                runs.append(("table", section, [int(x[-6:]) for x in tables[k][3].split("|")]))
        elif runs and runs[-1][0] == path and runs[-1][2][-1] == k - 1:
            runs[-1][2].append(k)
        else:
            runs.append((path, section, [k]))
    for n, (path, section, ks) in enumerate(runs, 1):
        head = _BLOCKS[ks[0] - 1][6].replace("/", "\n")
        ids = _BAR(f"{{key}}-0-{k:06d}" for k in ks)
        if path == "table":
            c = tables[ks[0]]
            out.append((f"{{key}}-CHUNK-{n:06d}", n, "table", section, f"{head}\n\n{c[-1]}", ids, None, None, c[0], c[1], c[4]))
        else:
            body = "\n\n".join(("- " if _BLOCKS[k - 1][0] == "list_item" else "") + _BLOCKS[k - 1][7] for k in ks)
            out.append((f"{{key}}-CHUNK-{n:06d}", n, "narrative", section, f"{head}\n\n{body}", ids, "0", body, None, None, None))
    return out


def _chunks_sql() -> str:
    """The end of a narrative chunk's span is the length of its body, filled as it is."""
    names = "chunk_id chunk_index content_type section text block_ids source_text_start source_text_end logical_table_id composition_mode title".split()
    return f"SELECT * REPLACE (source_text_start::INT AS source_text_start, length(source_text_end)::INT AS source_text_end) FROM ({_from_templates(_chunks(), names)})"


_COUNTS = {"blocks": 24, "headings": 5, "paragraphs": 5, "list_items": 5, "table_blocks": 11, "source_tables": 10, "logical_tables": 6, "continuations": 3, "untitled_financial": 2, "data_tables": 5, "text_tables": 4, "financial": 5, "structured": 2, "exhibit_lists": 1, "layouts": 1, "inherited_titles": 1, "inherited_units": 1, "explicit_headers": 4, "headerless": 1, "regions": 4, "sections": 2, "faulty": 0, "source_cells": 78}


ORACLE_SQL = {
    "filing_chunks": _chunks_sql(),
    "filing_audit": "SELECT c_custkey AS doc, " + ", ".join(f"{v}::BIGINT AS {k}" for k, v in _COUNTS.items()) + ", 0.0::DOUBLE AS max_logical_empty FROM customer UNION ALL SELECT NULL, " + ", ".join(("4::BIGINT" if k == "regions" else "2::BIGINT" if k == "sections" else f"{v} * count(*)") for k, v in _COUNTS.items()) + ", 0.0::DOUBLE FROM customer",
    "filing_violations": """WITH c AS (SELECT c_custkey % 13 AS m FROM customer)
SELECT * FROM (SELECT unnest(['index_gap', 'blank_text', 'duplicate_id', 'broken_continuation', 'not_rectangular', 'roles_mismatch']) AS rule,
  unnest([count_if(m = 1) * 19, count_if(m = 2), CASE WHEN count_if(m = 3) > 1 THEN count_if(m = 3) ELSE 0 END, count_if(m = 4), count_if(m = 5), count_if(m = 6)]) AS blocks FROM c) WHERE blocks > 0""",
    "filing_blocks": _from_templates([(k, f"{{key}}-0-{k:06d}", *b) for k, b in enumerate(_BLOCKS, 1)], "block_index block_id content_type source_tag source_anchor heading_kind section document_region path text".split()),
    "filing_tables": _from_templates(_TABLES, _TABLE_NAMES),
    "filing_compositions": _from_templates(_COMPOSED, "logical_table_id mode fragments block_ids title headers units context rows row_roles row_sources text".split()),
    "filing_cell_states": _states_sql(),
    "filing_facts": "SELECT c_custkey AS doc, 'entityregistrantname' AS fact, c_name AS value FROM customer",
    "nation_grid": """WITH n AS (SELECT n_regionkey::BIGINT AS doc, n_name, n_nationkey, row_number() OVER w AS k, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)),
c AS (
  SELECT doc, 0 AS row_index, 0 AS col_start, 2 AS col_end, 1 AS rowspan, 'Place of x' AS text, true AS header, true AS bold, false AS centered, false AS border, 'text' AS kind FROM n WHERE k = 1
  UNION ALL SELECT doc, 0, 2, 3, 1, 'Code', true, true, false, false, 'text' FROM n WHERE k = 1
  UNION ALL SELECT doc, 0, 3, 4, 1, 'Nested', true, true, false, false, 'text' FROM n WHERE k = 1
  UNION ALL SELECT doc, 1, 0, 1, n, 'Region ' || doc, true, true, false, false, 'text' FROM n WHERE k = 1
  UNION ALL SELECT doc, k, 1, 2, 1, n_name, false, false, false, false, 'text' FROM n
  UNION ALL SELECT doc, k, 2, 3, 1, format('{:,}', n_nationkey * 1000), false, false, true, false, 'numeric_scalar' FROM n
  UNION ALL SELECT doc, k, 3, 4, 1, 'inner', false, false, false, true, 'text' FROM n)
SELECT doc, 1 AS table_index, row_index::INT AS row_index, col_start, col_end, rowspan::INT AS rowspan, text, header, bold, centered, border, kind FROM c""",
}
