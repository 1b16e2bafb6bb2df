"""Constraint suites as tables of violations, and the reports built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import iso_date
from tessera.operators.logical import violations


def block_violations(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """(block_id, rule): indexes run from 1 without a gap, ids are unique, texts are not blank, continuations name an earlier table of the document."""
    w = Window.partitionBy(doc).orderBy("block_index")
    rows = blocks.withColumn("_n", F.row_number().over(w)).withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("block_id")))
    rules = {"index_gap": F.col("_n") == F.col("block_index"), "duplicate_id": F.col("_same") == 1, "blank_text": F.trim("text") != ""}
    if "logical_rows" in blocks.columns:
        rectangular = F.col("logical_rows").isNull() | F.forall("logical_rows", lambda r: F.size(r) == F.col("logical_width"))
        rules["not_rectangular"] = rectangular
        rules["roles_mismatch"] = F.col("logical_rows").isNull() | (F.size("logical_rows") == F.size("logical_row_roles"))
    found = violations(rows, "block_id", rules)
    if "continued_from_block_id" in blocks.columns:
        links = blocks.filter("continued_from_block_id IS NOT NULL").select("block_id", F.col("continued_from_block_id").alias("_to"), F.col(doc).alias("_d"), F.col("block_index").alias("_i"))
        earlier = blocks.select(F.col("block_id").alias("_to"), F.col(doc).alias("_d2"), F.col("block_index").alias("_j"))
        broken = links.join(earlier, "_to", "left").filter("_d2 IS NULL OR _d <> _d2 OR _j >= _i").select("block_id", F.lit("broken_continuation").alias("rule"))
        found = found.unionByName(broken)
    return found


def chunk_violations(chunks: DataFrame, blocks: DataFrame, size: int, doc: str = "doc") -> DataFrame:
    """(chunk_id, rule): unique ids, no blank text, narrative within size, known blocks; blocks that no chunk covers appear under their own id."""
    rows = chunks.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("chunk_id")))
    found = violations(rows, "chunk_id", {"duplicate_id": F.col("_same") == 1, "blank_text": F.trim("text") != "", "too_long": (F.col("content_type") != "narrative") | (F.col("n_tokens") <= size), "no_blocks": F.size("block_ids") > 0})
    used = chunks.select("chunk_id", F.explode("block_ids").alias("block_id"))
    known = blocks.select("block_id", "content_type")
    unknown = used.join(known, "block_id", "left_anti").select("chunk_id", F.lit("unknown_block").alias("rule"))
    lost = known.filter("content_type <> 'navigation'").join(used, "block_id", "left_anti").select(F.col("block_id").alias("chunk_id"), F.lit("uncovered_block").alias("rule"))
    return found.unionByName(unknown).unionByName(lost)


def embedding_violations(vectors: DataFrame, chunks: DataFrame, width: int, key: str = "chunk_id", vector: str = "embedding", tolerance: float = 1e-3) -> DataFrame:
    """(key, rule): every chunk has one finite unit vector of the right width whose text hash is the chunk's."""
    square = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    rows = chunks.select(key, F.sha2("text", 256).alias("_want")).join(vectors, key, "left")
    finite = ~F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return violations(rows, key, {"missing": F.col(vector).isNotNull(), "width": F.size(vector) == width, "not_finite": finite, "not_unit": F.abs(F.sqrt(square) - 1) <= tolerance, "stale_text": F.col("text_sha256") == F.col("_want")})


def manifest(vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: vectors, width, and a digest of all text hashes (a sum by key, so that no task holds them all and equal rows do not cancel)."""
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).alias("width"), F.sum(F.xxhash64(key, "text_sha256").cast("decimal(38,0)")).alias("digest"))


def filing_report(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """Blocks, tables by kind, titles, headers, continuations, regions and quality of each filing and, under a null filing, of the corpus."""
    count = lambda condition, name: F.count_if(condition).alias(name)
    type_is, kind_is = (lambda x: F.col("content_type") == x), (lambda x: F.col("table_kind") == x)
    has = lambda name: F.array_contains("inherited_fields", name)
    return blocks.rollup(doc).agg(
        F.count(F.lit(1)).alias("blocks"), count(type_is("heading"), "headings"), count(type_is("paragraph"), "paragraphs"), count(type_is("list_item"), "list_items"),
        F.count("table_kind").alias("table_blocks"), F.count_distinct("html_table_id", "html_table_xpath").alias("source_tables"), F.count_distinct("logical_table_id").alias("logical_tables"), F.count("continued_from_block_id").alias("continuations"),
        count(kind_is("financial_data") & F.col("title").isNull(), "untitled_financial"), count(type_is("data_table"), "data_tables"), count(type_is("text_table"), "text_tables"),
        count(kind_is("financial_data"), "financial"), count(kind_is("structured_text"), "structured"), count(kind_is("exhibit_list"), "exhibit_lists"), count(kind_is("layout"), "layouts"),
        count(has("title"), "inherited_titles"), count(has("units"), "inherited_units"), count(F.col("header_mode") == "explicit", "explicit_headers"), count(F.col("header_mode") == "headerless", "headerless"),
        F.count_distinct("document_region").alias("regions"), F.count_distinct("section").alias("sections"), count(F.size("table_faults") > 0, "faulty"), F.coalesce(F.sum("source_cells"), F.lit(0)).alias("source_cells"),
        F.max("logical_empty_density").alias("max_logical_empty"),
    )


def metadata_violations(filings: DataFrame, companies: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc, rule): a filing's ticker, CIK, form and period must agree with the company table and its own cover facts.

    `filings` has doc, ticker, cik, form, filing_year; `companies` ticker and cik; `facts` (doc, fact, value).
    """
    wanted = {"tradingsymbol": "f_ticker", "entitycentralindexkey": "f_cik", "documenttype": "f_form", "documentperiodenddate": "f_period"}
    cover = facts.filter(F.col("fact").isin(list(wanted))).groupBy("doc").agg(*[F.max(F.when(F.col("fact") == k, F.col("value"))).alias(v) for k, v in wanted.items()])
    known = companies.select("ticker", F.col("cik").alias("c_cik"))
    rows = filings.join(known, "ticker", "left").join(cover, "doc", "left")
    agrees = lambda a, b: F.col(a).isNull() | (F.upper(a) == F.upper(b))
    year = F.year(F.try_to_timestamp(iso_date(F.col("f_period"))))
    rules = {
        "unknown_company": F.col("c_cik").isNotNull(), "cik": F.ltrim("cik", F.lit("0")) == F.ltrim("c_cik", F.lit("0")), "cover_cik": F.col("f_cik").isNull() | (F.ltrim("f_cik", F.lit("0")) == F.ltrim("cik", F.lit("0"))),
        "cover_ticker": agrees("f_ticker", "ticker"), "form": (F.col("form") == "10-K") & agrees("f_form", "form"), "period": F.col("f_period").isNull() | (year == F.col("filing_year")),
    }
    return violations(rows, "doc", rules)
