"""Filing HTML to ordered blocks: one walk a document.

Documents are independent, so they are walked in Arrow batches; a block's row says where it came
from (document, position, section, region, anchor). Tables go through the table engine.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.cells import normalize
from tessera.operators import tables
from tessera.operators.dom import HEADINGS, Node, clean, parse, source_anchor, visible_text

# Heading patterns and regions of filings.
ITEM = re.compile(r"item\s+(\d{1,2}[a-z]?)\s*[.\-—:]?\s*(.+?)\.?", re.IGNORECASE)
REGIONS = {
    "filing_body": "Filing body", "financial_statements": "Financial statements", "financial_statement_notes": "Financial statement notes",
    "financial_statement_schedules": "Financial statement schedules", "exhibits": "Exhibits", "signatures": "Signatures",
}
REGION_HEADINGS = [
    ("signatures", r"SIGNATURES|POWER OF ATTORNEY"),
    ("exhibits", r"EXHIBITS?|EXHIBIT INDEX"),
    ("financial_statement_schedules", r"FINANCIAL STATEMENT SCHEDULES|SCHEDULE II\b.*"),
    ("financial_statement_notes", r"NOTES? TO (?:THE )?(?:CONSOLIDATED )?FINANCIAL STATEMENTS(?: \(CONTINUED\))?"),
    ("financial_statements", r"(?:CONSOLIDATED |COMBINED )?(?:STATEMENTS? OF .+|BALANCE SHEETS?|STATEMENTS? OF CASH FLOWS|STATEMENTS? OF STOCKHOLDERS['’]? EQUITY)"),
]
LISTS = frozenset(("ul", "ol"))
NOTE = re.compile(r"NOTE\s+\d+[A-Z]?(?:\.|\s*[-—–])\s*.+")


def item_section(n: Node, text: str) -> str | None:
    """'Item N — Title' of a bold or upper-case item heading."""
    hit = ITEM.fullmatch(text) if len(text) <= 250 else None
    if not hit or not (text.isupper() or n.has_bold):
        return None
    return f"Item {hit.group(1).upper()} — {hit.group(2).strip().rstrip('.')}"


def is_subheading(n: Node, text: str) -> bool:
    """A short paragraph that is bold as a whole, outside tables and lists, without a link into the page."""
    if n.tag not in ("p", "div") or not text or len(text) > 200 or len(text.split()) > 25 or text[-1] in ".?!;":
        return False
    if not n.has_bold or n.has_link or n.listed:
        return False
    return any(x.bold and x.brief is not None and normalize(x.brief) == text for x in n.nodes())


def is_leaf_div(n: Node) -> bool:
    return n.tag == "div" and not n.blank and not n.has_inner


class Walk:
    """One document's walk; state is what later blocks inherit."""

    def __init__(self, ticker: str, year: int, company: str = "", whole_body: bool = False):
        self.ticker, self.year, self.company = ticker, year, company
        self.started = whole_body
        self.section, self.subsection, self.anchor, self.region = "Cover", None, None, "filing_body"
        self.blocks: list[dict] = []
        self.tables = 0
        self.last_table: dict | None = None
        self.since_table = 0

    def path(self) -> list[str]:
        path = [self.section]
        if self.subsection and (self.region not in ("exhibits", "signatures") or self.region[:-1] in self.subsection.casefold()):
            path.append(self.subsection)
        label = REGIONS[self.region]
        if self.region != "filing_body" and not any(label.casefold() in p.casefold() for p in path):
            path.append(label)
        return path

    def emit(self, kind: str, text: str, n: Node, tag: str | None = None, **extra) -> dict:
        k = len(self.blocks) + 1
        block = {
            "block_id": f"{self.ticker}-{self.year}-{k:06d}", "block_index": k, "ticker": self.ticker, "filing_year": self.year, "company": self.company,
            "section": self.section, "section_path": [self.section, *([self.subsection] if self.subsection else [])], "document_region": self.region,
            "effective_section_path": self.path(), "content_type": kind, "text": text, "source_tag": tag or n.tag, "source_anchor": source_anchor(n) or self.anchor, **extra,
        }
        self.blocks.append(block)
        if kind in ("heading", "paragraph", "list_item") and self.last_table is not None:
            self.since_table += 1
        return block

    def enter(self, text: str, item: bool) -> None:
        """Region changes that a heading brings."""
        if item:
            self.region = "financial_statements" if self.section.split("—")[0].strip().casefold() == "item 8" else "filing_body"
            return
        upper = normalize(text).rstrip(":").upper()
        if not upper or len(upper) > 250:
            return
        for region, pattern in REGION_HEADINGS:
            if re.fullmatch(pattern, upper):
                self.region = region
                return
        if self.region.startswith("financial") and NOTE.match(upper):
            self.region = "financial_statement_notes"

    def text_block(self, n: Node) -> None:
        text = visible_text(n)
        if not text:
            return
        section = item_section(n, text)
        if section:
            self.section, self.subsection, self.anchor = section, None, source_anchor(n)
            self.enter(text, item=True)
            self.emit("heading", text, n, heading_kind="item", heading_level=1)
        elif n.tag in HEADINGS or is_subheading(n, text):
            self.subsection = text
            self.enter(text, item=False)
            self.emit("heading", text, n, heading_kind="subsection", heading_level=2)
        else:
            self.emit("paragraph", text, n)

    def table_block(self, n: Node) -> None:
        for block in tables.blocks_of(n, self):
            self.emit(**block)
            if block["kind"] != "list_item" and "fragment" in block:
                self.last_table, self.since_table = self.blocks[-1], 0

    def visit(self, top: Node) -> None:
        """Nodes in document order; texts, items and tables are not gone into, but for lists in items."""
        stack = [top]
        while stack:
            n = stack.pop()
            inside = [c for c in n.children if isinstance(c, Node)]
            if n.tag == "table":
                self.tables += 1
                if self.started:
                    self.table_block(n)
            elif n.tag == "p" or n.tag in HEADINGS or is_leaf_div(n):
                section = None if self.started else item_section(n, visible_text(n))
                self.started |= bool(section) and section.startswith("Item 1 —") and not n.has_link
                if self.started:
                    self.text_block(n)
            elif n.tag == "li":
                if self.started and (text := visible_text(n, LISTS)):
                    self.emit("list_item", text, n)
                stack += [c for c in reversed(inside) if c.tag in LISTS and self.started]
            else:
                stack += reversed(inside)


def extract_blocks(html_text: str | None, ticker: str, year: int, company: str = "", whole_body: bool = False) -> list[dict]:
    """The blocks of one document; without `whole_body` they start at the first Item 1 heading."""
    root = parse(html_text, fold=True)
    clean(root)
    body = next((n for n in root.nodes() if n.tag == "body"), root)
    walk = Walk(ticker, year, company, whole_body)
    for c in body.children:
        if isinstance(c, Node):
            walk.visit(c)
    return walk.blocks


def facts(html_text: str | None) -> dict[str, str]:
    """The first value of each named inline XBRL fact, by the name's local part in lower case."""
    out: dict[str, str] = {}
    for n in parse(html_text).nodes():
        if n.tag.startswith("ix:") and "name" in n.attrs:
            value = normalize(n.raw_text())
            if value:
                out.setdefault(n.attrs["name"].rsplit(":", 1)[-1].lower(), value)
    return out


def filing_facts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc, fact, value) of every page's inline XBRL facts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(d, k, v) for d, t in zip(f["doc"], f["html"]) for k, v in facts(t).items()], columns=["doc", "fact", "value"])

    return pages.select(F.col(id_col).cast("long").alias("doc"), F.col(html_col).alias("html")).mapInPandas(run, "doc bigint, fact string, value string")


CELL_SCHEMA = "doc bigint, table_index int, row_index int, col_start int, col_end int, rowspan int, text string, header boolean, bold boolean, centered boolean, border boolean, kind string"


def source_cells(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row a source cell of every outermost table: its place on the grid and how it looks. Tables inside cells are the cells' text."""
    names = [f.strip().split(" ")[0] for f in CELL_SCHEMA.split(",")]

    def cells(doc: int, text: str | None) -> Iterator[tuple]:
        root = parse(text)
        clean(root)
        outer = (n for n in root.nodes() if n.tag == "table" and not n.listed)
        for k, n in enumerate(outer, 1):
            for c in tables.grid(n):
                if c.text:
                    yield doc, k, c.row, c.start, c.end, c.rowspan, c.text, c.header, c.bold >= 0.5, c.centered, c.border, c.cell.kind

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([row for d, t in zip(f["doc"], f["html"]) for row in cells(d, t)], columns=names)

    return pages.select(F.col(id_col).cast("long").alias("doc"), F.col(html_col).alias("html")).mapInPandas(run, CELL_SCHEMA)


BLOCK_SCHEMA = (
    "doc bigint, block_id string, block_index int, section string, section_path array<string>, document_region string, effective_section_path array<string>, "
    "content_type string, text string, source_tag string, source_anchor string, heading_kind string, table_kind string, title string, units string, header_mode string, "
    "logical_width int, logical_column_headers array<string>, logical_column_units array<string>, logical_rows array<array<string>>, logical_row_roles array<string>, "
    "logical_table_id string, continued_from_block_id string, title_source string, table_reasons array<string>, logical_header_paths array<array<string>>, "
    "logical_header_context array<string>, logical_roles array<string>, logical_cell_states array<array<string>>, logical_row_source_indexes array<int>, "
    "continuation_reasons array<string>, inherited_fields array<string>, table_faults array<string>, source_cells int, physical_empty_density double, "
    "logical_empty_density double, width_ratio double, accounted double, html_table_id string, html_table_xpath string, html_table_sha256 string"
)


PAGES_AT_ONCE = 64


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", whole_body: bool = True) -> DataFrame:
    """One row a block of each document, in order of (doc, block_index)."""
    schema = T.StructType.fromDDL(BLOCK_SCHEMA)
    target = to_arrow_schema(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # trees are cyclic and short-lived: collecting them after every few pages is far cheaper than while they grow
        try:
            for part in (batch.slice(at, PAGES_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, PAGES_AT_ONCE)):
                columns: dict[str, list] = {name: [] for name in names}
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = extract_blocks(text, str(doc), 0, whole_body=whole_body)
                    for name, values in columns.items():
                        values += [b.get(name) for b in found] if name != "doc" else [doc] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)
                del columns
                gc.collect(0)
        finally:
            gc.enable()

    return pages.select(F.col(id_col).cast("long").alias("doc"), F.col(html_col).alias("html")).mapInArrow(run, BLOCK_SCHEMA)
