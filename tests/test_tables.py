"""Cell typing, the table engine and block extraction on HTML of our own."""

import pytest

from tessera.functions import cells as C
from tessera.operators import dom
from tessera.operators import html as H
from tessera.operators import tables as T

KINDS = {
    "": "empty", "—": "missing_numeric", "–": "missing_numeric", "N/A": "missing_numeric", "not meaningful": "missing_numeric", "$": "currency_marker", "%": "percent_marker",
    "—%": "percentage", "— %": "percentage", "$ —": "missing_numeric", "**": "footnote_marker", "†": "footnote_marker", "12/31/2024": "date", "2024-12-31": "date",
    "Dec. 31, 2024": "date", "001-12345": "exhibit_or_file_identifier", "3-5 years": "duration", "12 months": "duration", "+/- 50 bps": "numeric_range", "1,234": "numeric_scalar",
    "(1,234.5)": "numeric_scalar", "-5": "numeric_scalar", "$ 7": "numeric_scalar", "12%": "percentage", "(3)%": "percentage", "2024": "year", "10.1": "numeric_scalar", "5% - 7%": "percentage_range",
    "2020 - 2024": "year_range", "10-12": "numeric_range", "$1 to $2": "numeric_range", "F-12": "text", "hello": "text", "1,234(1)": "numeric_scalar", "5*": "numeric_scalar", "$5/$7": "numeric_range",
}


@pytest.mark.parametrize("text,kind", KINDS.items())
def test_kinds(text, kind):
    assert C.analyze(text).kind == kind


def test_kinds_as_expression_agree(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(t,) for t in KINDS], "t string").select("t", C.kind(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == KINDS


def test_values_of_cells():
    a = C.analyze("$(1,234.50)")
    assert (a.numeric_value, a.currency, a.accounting_negative) == (-1234.5, "USD", True)
    r = C.analyze("+/- $50")
    assert (r.range_start, r.range_end, r.currency) == (-50, 50, "USD")
    assert C.analyze("7(1)").footnote == "(1)" and C.analyze("3 to 5 years").range_end == 5
    assert C.refine(C.analyze("10.1"), "Exhibit No.").kind == "exhibit_or_file_identifier"
    assert C.normalize(" a \xa0 b­c\n\n\n d ") == "a bc\n\n d" or C.normalize("a\xa0b") == "a b"


def table(body):
    root = H.parse(f"<body><table>{body}</table></body>")
    H.clean(root)
    return next(n for n in root.nodes() if n.tag == "table")


def rows(*lines):
    return "".join("<tr>" + "".join(c if c.startswith("<t") else f"<td>{c}</td>" for c in line) + "</tr>" for line in lines)


INCOME = rows(
    ["", '<td colspan="4" style="text-align:center"><b>Year ended December 31,</b></td>'],
    ["", '<td colspan="2" style="text-align:center"><b>2024</b></td>', '<td colspan="2" style="text-align:center"><b>2023</b></td>'],
    ["Revenue", "$", "1,200", "$", "900"],
    ["Cost of revenue", "", "(300)", "", "(200)"],
    ["Other:"],
    ["Interest income", "", "—", "", "5"],
    ["Total income", "$", "900", "$", "705"],
)


def test_grid_places_spans():
    raws = T.grid(table(rows(['<td rowspan="2">a</td>', "b"], ["c"], ['<td colspan="2">d</td>'])))
    assert [(c.text, c.row, c.start, c.end) for c in raws] == [("a", 0, 0, 1), ("b", 0, 1, 2), ("c", 1, 1, 2), ("d", 2, 0, 2)]
    assert T.span("x") == 1 and T.span("0") == 1 and T.span("3") == 3 and T.span(None) == 1


def test_financial_table():
    f = T.fragment_of(T.grid(table(INCOME)))
    assert (f.width, f.roles, f.header_mode) == (3, ["row_label", "value", "value"], "inferred")
    assert f.context == ["Year ended December 31,"] and f.headers == ["Line item", "2024", "2023"]
    assert f.rows[0] == ["Revenue", "$1,200", "$900"] and f.rows[1] == ["Cost of revenue", "(300)", "(200)"]
    assert f.row_roles == ["data", "data", "section_label", "data", "total"] and f.states[3][1] == "missing_marker"
    assert f.units == ["text", "usd", "usd"] and f.kind == "financial_data"
    assert T.faults(f) == [] and T.valid_markdown("\n".join(T.markdown(f)))
    q = T.quality(f)
    assert q["logical_empty_density"] == 0 and q["accounted"] < 1


def test_other_kinds():
    toc = T.fragment_of(T.grid(table(rows(["Business", "1"], ["Risk Factors", "12"], ["Properties", "30"]))))
    assert toc.kind == "index_navigation"
    exhibits = T.fragment_of(T.grid(table(rows(["<th>Exhibit No.</th>", "<th>Description</th>"], ["3.1", "Certificate of Incorporation"], ["10.2", "Form of award agreement"]))))
    assert exhibits.kind == "exhibit_list" and exhibits.header_mode == "explicit"
    people = T.fragment_of(T.grid(table(rows(["<th>Name</th>", "<th>Position</th>"], ["Ann", "Engineer of record"], ["Bob", "Head of quality"]))))
    assert people.kind == "structured_text" and people.rows[1] == ["Bob", "Head of quality"]
    assert T.fragment_of(T.grid(table(rows(["/s/ Ann"], ["Principal Executive Officer"])))).kind == "layout"
    assert T.fragment_of(T.grid(table(rows(["", ""])))) is None


def test_percent_columns_and_duplicate_headers():
    f = T.fragment_of(T.grid(table(rows(["", '<th colspan="2">2024</th>'], ["Margin", "5", "12%"], ["Share", "6", "15%"]))))
    assert f.units == ["text", "number", "percent"] and f.headers == ["Line item", "2024 — Amount", "2024 — Percent"]


def test_bullets_titles_and_lists():
    blocks = H.extract_blocks(
        "<p><b>Item 1. Business</b></p><p>Intro text. The following table summarizes our sites:</p>"
        f"<table>{rows(['<th>Site</th>', '<th>Use of site</th>'], ['Reno', 'Manufacturing plant'], ['Austin', 'Research and offices'])}</table>"
        f"<table>{rows(['•', 'one'], ['', 'more'], ['•', 'two'])}</table><ul><li>a<ul><li>b</li></ul></li></ul>",
        "ABC", 2024,
    )
    assert [b["content_type"] for b in blocks] == ["heading", "paragraph", "text_table", "list_item", "list_item", "list_item", "list_item"]
    assert blocks[2]["title"] == "The following table summarizes our sites" and blocks[3]["text"] == "one more"
    assert [b["block_index"] for b in blocks] == list(range(1, 8)) and blocks[0]["block_id"] == "ABC-2024-000001"


def test_continuation_links_and_inherits():
    head = ["<th>Item</th>", "<th>Amount</th>"]
    first = f"<table>{rows(head, ['Cash', '$ 1'], ['Debt', '$ 2'])}</table>"
    second = f"<table>{rows(head, ['Leases', '$ 3'], ['Taxes', '$ 4'])}</table>"
    start = "<p><b>Item 8. Financial Statements</b></p><p><b>Balance sheet data</b></p>"
    get = lambda between: [b for b in H.extract_blocks("<p><b>Item 1. Business</b></p>" + start + first + between + second, "T", 2024) if "table" in b["content_type"]]
    near, far = get(""), get("<p>Some other text.</p>")
    assert near[1]["logical_table_id"] == near[0]["logical_table_id"] and near[1]["continued_from_block_id"] == near[0]["block_id"]
    assert near[1]["title"] == "Balance sheet data"
    assert far[1]["logical_table_id"] != far[0]["logical_table_id"]
    assert not T.CONTINUED.search("Discontinued operations") and T.CONTINUED.search("Note 3 ( Continued )")


def test_regions_and_sections():
    page = "<p><b>Item 1. Business</b></p><p>x</p><p><b>Item 8. Financial Statements</b></p><p><b>Notes to Consolidated Financial Statements</b></p><p>y</p><p><b>SIGNATURES</b></p><p>z</p>"
    got = {b["text"]: (b["document_region"], b["effective_section_path"]) for b in H.extract_blocks(page, "T", 2024)}
    assert got["x"][0] == "filing_body" and got["y"][0] == "financial_statement_notes" and got["z"][0] == "signatures"
    assert got["y"][1] == ["Item 8 — Financial Statements", "Notes to Consolidated Financial Statements", "Financial statement notes"] or got["y"][1][0] == "Item 8 — Financial Statements"


def test_cleaning_and_text():
    root = H.parse('<body><div style="display:none">no</div><script>no</script><p>a<b>b</b>c<br>d co-<br>op soft­<br>ware<div>e</div><ix:nonFraction unitRef="usd" scale="6">5</ix:nonFraction></p><hr style="page-break-after: always"></body>')
    assert H.clean(root) == 1
    assert dom.visible_text(root) == "abc d co-op software e 5"
    assert H.extract_blocks(None, "T", 1) == [] and H.extract_blocks("<p>unclosed <b>x", "T", 1, whole_body=True)[0]["text"] == "unclosed x"
    open_tags = H.extract_blocks("<p><b>one<br><p>two<li>three<li>four", "T", 1, whole_body=True)
    assert [b["text"] for b in open_tags] == ["one", "two", "three", "four"]


def test_depth_and_length_of_a_page_cost_no_more_than_their_size():
    import time

    start = time.perf_counter()
    assert len(H.extract_blocks("<div>" * 20_000 + "deep <b>x</b>", "T", 1, whole_body=True)) == 1
    assert len(H.extract_blocks("<p><b>Item 1. Business</b></p>" + "<div><p>a <b>x</b></p>" * 20_000, "T", 1)) == 20_001
    assert len(H.extract_blocks("<ul>" + "<li>a<ul>" * 10_000, "T", 1, whole_body=True)) == 10_000
    assert time.perf_counter() - start < 60
    many = "<body>" + "<span>w </span>" * 45 + "</body>"
    wide = H.parse(f'<body><p><a href="#toc">{"<i></i>" * 45}Table of Contents</a></p>{many}</body>')
    assert H.clean(wide) == 1  # however many children it has


def test_markdown_rows():
    assert T.split_row(r"| a \| b | c |") == [r"a \| b", "c"]
    assert not T.valid_markdown("| a | b |\n| --- | --- |\n| c |") and not T.valid_markdown("| a |")
    assert T.set_overlap({"a", "b"}, {"b"}) == 1.0 and T.path_similarity([["a"], ["b"]], [["a"]]) == 0.5


def test_html_blocks_in_spark(spark):
    pages = spark.createDataFrame([(1, "<h1>T</h1><p>x"), (2, None), (3, f"<table>{INCOME}</table>"), (4, "<div>" * 3000 + "deep")], "page_id long, html string")
    got = H.html_blocks(pages).collect()
    assert [(r.doc, r.content_type) for r in got if r.doc < 4] == [(1, "heading"), (1, "paragraph"), (3, "data_table")]
    assert any(r.doc == 4 and r.text == "deep" for r in got) and next(r for r in got if r.doc == 3).logical_rows[0] == ["Revenue", "$1,200", "$900"]


@pytest.mark.parametrize("first, other, role, unit", [("1950", "7", "value", "number"), ("7", "2024", "value", "number"), ("1950", "1960", "years", "years"), ("2024", "3 years", "years", "years"), ("1950", "—", "years", "years")])
def test_numbers_that_read_as_years(first, other, role, unit):
    f = T.fragment_of(T.grid(table(rows(["<th>Region</th>", "<th>Customers</th>"], ["North", first], ["South", other]))))
    assert (f.roles[1], f.units[1]) == (role, unit)
    now = T.fragment_of(T.grid(table(rows(["<th>Region</th>", "<th>Suppliers</th>"], ["North (continued)", "11"], ["West", "12"]))))
    assert T.continues(now, f, True, 0)[0] == (role == "value")


def _page(*cells):
    lines = rows(["<th>Region</th>", "<th>Orders</th>", "<th>Value</th>"], *([f"R{k} of {c}", c, "$" + c] for k, c in enumerate(cells)))
    return f'<html><body><p><b>Item 1. Business</b></p><p>The following table shows {cells[0]} orders:</p><table>{lines}</table><table>{lines}</table></body></html>'


CELLS = [("1,234", "56,789"), ("9,876", "10,000"), ("9,876", "9,876"), ("12345", "67890"), ("54321", "54321"), ("1996", "1,996"), ("1<i>2345</i>", "12,345"), ("12,3<b>45</b>", "12,345"), ("&#49;2345", "12345"), ("12345.5", "12345,"), ("1,234%", "(1)"), ("—", "1,234"), ("&amp;#12345;", "12345"), ("\x0012345", "12345")]


def test_known_forms_change_nothing():
    for cells in CELLS * 2:
        known = H.extract_blocks(_page(*cells), "d", 0)
        kept = dict(T.FORMS)
        T.FORMS.clear()
        fresh = H.extract_blocks(_page(*cells), "d", 0)
        T.FORMS.update(kept)
        assert [{k: v for k, v in b.items() if k != "fragment"} for b in known] == [{k: v for k, v in b.items() if k != "fragment"} for b in fresh]


def test_tables_of_one_form_are_read_once(monkeypatch):
    T.FORMS.clear()
    read, first = [], T.fragment_of
    monkeypatch.setattr(T, "fragment_of", lambda *a: read.append(a) or first(*a))
    pages = [H.extract_blocks(_page(f"{k},234", f"{k}6,789"), "d", 0) for k in range(1, 9)]
    assert len(read) <= 2 and pages[7][2]["logical_rows"] == [["R0 of 8,234", "8,234", "$8,234"], ["R1 of 86,789", "86,789", "$86,789"]]
    assert pages[3][2]["title"] == "The following table shows 4,234 orders"


@pytest.mark.parametrize("text", ["<p>a<br>b", "<P CLASS='x'>a</P>", "a < b", "<script>if (a < b) {'</p>'}</script >x", "<style>p</style>q", "<script>x", "<p hidden>h</p>x", "<ix:nonNumeric name='a:b'>v</ix:nonNumeric>", "a &amp; b &lt", "<!-- c --><td>x", "<a href=\"#x\" b>y</a><br/>z</q>", "</p>x<", "<li>a<li>b"])
def test_plain_and_other_markup_make_one_tree(text):
    slow = dom._Builder()
    slow.feed(f"<html><body>{text}")
    slow.close()
    fast = dom.parse(f"<html><body>{text}")
    assert dom.markup(fast) == dom.markup(slow.root) and fast.raw_text() == slow.root.raw_text()


INSIDE = [
    "<tr><td>Cash</td><td>12,345</td></tr>", "<tr><td>i</td><td>12</td></tr>", '<tr><td style="display:none">x</td><td>12,345</td></tr>', '<tr><td style="text-align:center">12</td><td style="position:absolute;bottom:0">3</td></tr>', "<tr><td>a<dd>b<td>12,345",
    "<tr><td>&#12345;</td><td>12,345</td></tr>", "<tr><td>12345&comma;678</td><td>a &amp; b</td></tr>", "<tr><td>&frac12345;</td><td>1</td></tr>", '<tr><td rowspan="12345">a</td><td>12,345</td></tr>', "<tr><td>12345</TABLE><p>12,345</p>", "<tr><td>\x02</td><td>12,345</td></tr>",
    "<tr><td>1<!-- 2 -->2345</td></tr>", "<tr><td><table><tr><td>12,345</td></tr></table></td></tr>", "<tr><td><b>12,345</b></td><td>" + "long text " * 250 + "</td></tr>", '<tr><td><a href="#toc">Table of Contents</a></td></tr>', "<tr><td>12345<td>x > y</td></tr><tr>", "<tr><td>12,345</td></tr>",
]


@pytest.mark.parametrize("around", ["{}", "<div>{}</div>", '<div style="text-align:center"><div style="position:absolute;bottom:0">{}</div></div>', "<li>{}</li>", "<h1>{}</h1>", "<dl><dd>{}</dd></dl>", '<p id="here"></p>{}'])
def test_folded_tables_change_nothing(monkeypatch, around):
    first = dom.parse
    blocks = lambda page: [{k: v for k, v in b.items() if k != "fragment"} for b in H.extract_blocks(page, "d", 0, whole_body=True)]
    for inside in INSIDE:
        for digits in ("12,345", "98,765", "67890"):
            filled = inside.replace("12,345", digits)
            page = f"<html><body><p>Shown:</p>{around.format(f'<table>{filled}</table>')}<table><tr><td>{digits}</td><td>1</td></tr></table></body></html>"
            folded = blocks(page)
            T.FORMS.clear()
            with monkeypatch.context() as m:
                m.setattr(H, "parse", lambda text, fold=False: first(text))
                assert blocks(page) == folded


def test_a_known_table_is_not_parsed_again(monkeypatch):
    pages = [f"<html><body><table><tr><th>Place</th><th>Value</th></tr><tr><td>North</td><td>{k},234</td></tr></table></body></html>" for k in (1, 2)]
    one = H.extract_blocks(pages[0], "d", 0, whole_body=True)
    made = []
    monkeypatch.setattr(dom._Builder, "handle_starttag", lambda self, tag, attrs, first=dom._Builder.handle_starttag: made.append(tag) or first(self, tag, attrs))
    two = H.extract_blocks(pages[1], "d", 0, whole_body=True)
    assert made == ["html", "body", "table"] and two[0]["logical_rows"] == [["North", "2,234"]] and one[0]["logical_rows"] == [["North", "1,234"]]
