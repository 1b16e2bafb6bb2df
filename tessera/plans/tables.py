"""Queries over text, cells, tables in texts, and audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import cells
from tessera.functions.stats import distribution
from tessera.functions.text import iso_date, normalize
from tessera.operators import html, logical, release
from tessera.sources.tables import table


def cell_typing(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of all white-space separated tokens of all documents."""
    tokens = table(spark, sf, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[ \n\t]+")).alias("token"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))  # each distinct token is typed once
    return counted.groupBy(cells.kind(F.col("token")).alias("kind")).agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_distinct"))


def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.length(normalize(F.col("text"))).alias("chars"), F.sha2(normalize(F.col("text")), 256).alias("sha256"))


def text_normalize_full(spark: SparkSession, sf: str) -> DataFrame:
    """Entities, NFC, invisible characters and white space, as the block walk normalizes: Spark has no NFC, so in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(cells.normalize)

    marked = F.concat(F.lit("&amp;&lt;  a\u0301\u00ad \u200b"), F.coalesce("text", F.lit("")), F.lit("\n \n\n\u00a0end \t"))
    return table(spark, sf, "documents").select("doc_id", run(marked).alias("t")).select("doc_id", F.length("t").alias("chars"), F.sha2("t", 256).alias("sha256"))


def iso_date_parse(spark: SparkSession, sf: str) -> DataFrame:
    forms = ["yyyy-MM-dd", "MMMM d, yyyy", "MM/dd/yyyy", "yyyyMMdd", "d. MMM"]
    written = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        written = F.when(F.col("o_orderkey") % 5 == i, F.date_format("o_orderdate", f)).otherwise(written)
    return table(spark, sf, "orders").select("o_orderkey", written.alias("written")).select("o_orderkey", iso_date(F.col("written")).alias("iso"))


def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = html.html_blocks(table(spark, sf, "pages"))
    return blocks.select(F.col("doc").alias("page_id"), "block_index", "content_type", "source_tag", "section", "document_region", F.sha2("text", 256).alias("text_sha256"))


def html_visible_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    blocks = html.html_blocks(table(spark, sf, "pages"))
    return blocks.groupBy("content_type", "source_tag").agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("doc").alias("pages"), F.sum(F.length("text")).alias("chars"))


def table_grid_pipes(spark: SparkSession, sf: str) -> DataFrame:
    return logical.grid_density(logical.pipe_rows(table(spark, sf, "documents"), "doc_id", "text"), ["doc_id"])


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return logical.table_runs(logical.pipe_rows(table(spark, sf, "documents"), "doc_id", "text"), "doc_id")


def markdown_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Each run of pipe lines as a table of its own: its rows and whether all are equally wide."""
    return logical.grid_density(_runs(spark, sf), ["doc_id", "run"]).select("doc_id", "run", "n_rows", "width", "uniform")


def table_continuation(spark: SparkSession, sf: str) -> DataFrame:
    fragments = _runs(spark, sf).groupBy("doc_id", "run").agg(F.max(F.size("cells")).alias("width"), F.count(F.lit(1)).alias("n_rows"))
    return logical.linked(fragments, "doc_id", "run", ["width"])


def horizontal_compose(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers a nation, from two fragments whose labels differ in case and blanks."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    left = table(spark, sf, "customer").filter("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("k")).groupBy("name").agg(F.count(F.lit(1)).alias("customers"))
    right = table(spark, sf, "supplier").filter("s_acctbal > 0").join(nation, F.col("s_nationkey") == F.col("k")).groupBy("name").agg(F.count(F.lit(1)).alias("suppliers"))
    return logical.compose_horizontal(left, right.withColumn("name", F.concat(F.lit(" "), F.lower("name"), F.lit("  "))), "name").withColumn("name", F.trim("name"))


def distribution_audit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), *distribution("n_chars", "chars"))


def regression_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as they are against texts normalized, by document: how many changed."""
    docs = table(spark, sf, "documents")
    old = docs.filter("lang <> 'es'").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.filter("lang <> 'de'").select("doc_id", F.sha2(normalize(F.col("text")), 256).alias("h"))
    return logical.regression(old, new, "doc_id", "h").groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


def release_inventory(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = docs.groupBy("source", F.col("lang").alias("kind")).agg(F.sha2(F.concat_ws(",", F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))), 256).alias("sha256"))
    return release.inventory(docs, "source", ["en", "fr", "de", "es", "it"], found)


def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    text = logical.row_sentences(F.col("p_name"), ["Brand", "Type", "Size"], [F.col("p_brand"), F.col("p_type"), F.col("p_size")], "Parts")
    return table(spark, sf, "part").select("p_partkey", text.alias("text"))


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Latest clicks a user, replaced by the user's latest purchase where there is one."""
    latest = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).filter("k = 1").select("user_id", "event_id", "event_type", "value")
    events = table(spark, sf, "events")
    kinds = sorted(r.event_type for r in events.select("event_type").distinct().collect())  # a handful by schema
    return logical.upsert(latest(events.filter(F.col("event_type") == kinds[0])), latest(events.filter(F.col("event_type") == kinds[-1])), ["user_id"])


def company_rollup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.rollup("source", "lang").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


def title_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Constraint suite over first lines: which rule each document's title breaks, counted."""
    title = F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1)
    rows = table(spark, sf, "documents").select("doc_id", title.alias("title"))
    rules = {"missing": F.trim("title") != "", "overlong": F.length("title") <= 500, "page_label": ~F.col("title").rlike(r"^(?:[A-Za-z]-)?\d{1,3}$"), "truncated": ~F.col("title").rlike(r" (?:of|for|the|and|to|in|by)$")}
    return logical.violations(rows, "doc_id", rules).groupBy("rule").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {
    f.__name__: f
    for f in (
        cell_typing, text_normalize, text_normalize_full, iso_date_parse, html_blocks, html_visible_text_stats, table_grid_pipes, markdown_valid, table_continuation, horizontal_compose,
        distribution_audit, regression_diff, release_inventory, embedding_text, upsert_latest, company_rollup, title_audit,
    )
}

_NORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[' || chr(173) || chr(8203) || ']', '', 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{2,}', chr(10) || chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
_PIPES = r"""l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
p AS (SELECT doc_id, line, list_transform(string_split(regexp_replace(trim(raw), '^\||\|$', '', 'g'), '|'), lambda c: trim(c)) AS cells FROM l WHERE contains(raw, '|')),
r AS (SELECT *, sum((b IS DISTINCT FROM line - 1)::INT) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM p))"""


def _full(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '^(?i:{pattern})$')"


_KIND = f"""CASE WHEN trim(token) = '' THEN 'empty' WHEN {_full("trim(token)", f"[{cells.MISSING}]|{cells.MISSING_TEXT}")} THEN 'missing_numeric' WHEN {_full("plain", "[$€£¥]")} THEN 'currency_marker'
 WHEN plain = '%' THEN 'percent_marker' WHEN {_full("plain", "-[ ]*%")} THEN 'percentage' WHEN {_full("plain", "[$€£¥][ ]*-")} THEN 'missing_numeric' WHEN {_full("plain", "[*†‡]+")} THEN 'footnote_marker'
 WHEN {_full("plain", cells.DATE)} THEN 'date' WHEN {_full("plain", cells.FILE_NUMBER)} THEN 'exhibit_or_file_identifier' WHEN {_full("plain", cells.DURATION)} THEN 'duration'
 WHEN {_full("body", cells.PLUS_MINUS)} THEN 'numeric_range' WHEN {_full("body", f"(?:{cells.SCALAR})/(?:{cells.SCALAR})")} THEN 'numeric_range'
 WHEN {_full("body", cells.SCALAR)} AND body LIKE '%\\%' ESCAPE '\\' THEN 'percentage' WHEN {_full("body", cells.YEAR)} THEN 'year' WHEN {_full("body", cells.SCALAR)} THEN 'numeric_scalar'
 WHEN {_full("body", cells.RANGE)} AND contains(body, '%') THEN 'percentage_range' WHEN {_full("body", f"[$€£¥]?{cells.YEAR}-[$€£¥]?{cells.YEAR}")} THEN 'year_range' WHEN {_full("body", cells.RANGE)} THEN 'numeric_range' ELSE 'text' END"""

_FULL = r"""trim(regexp_replace(regexp_replace(replace(replace(replace('&<  ' || nfc_normalize('a' || chr(769) || chr(173) || ' ' || chr(8203) || coalesce(text, '')) || chr(10) || ' ' || chr(10) || chr(10) || chr(160) || 'end ' || chr(9), chr(160), ' '), chr(173), ''), chr(8203), ''),
 '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"""

ORACLE_SQL = {
    "text_normalize_full": f"SELECT doc_id, length({_FULL})::INT AS chars, sha256({_FULL}) AS sha256 FROM documents",
    "cell_typing": f"""WITH t AS (SELECT unnest(string_split_regex(coalesce(text, ''), '[ \\n\\t]+')) AS token FROM documents),
c AS (SELECT token, count(*) AS n, regexp_replace(trim(token), '[−–—]', '-', 'g') AS plain FROM t GROUP BY token),
s AS (SELECT *, regexp_extract(plain, '^(.+?)[ ]*{cells.SUFFIX}$', 1) AS cut FROM c),
b AS (SELECT *, CASE WHEN cut <> '' AND NOT contains(cut, '/') THEN trim(cut) ELSE plain END AS body FROM s)
SELECT {_KIND} AS kind, sum(n)::BIGINT AS n_tokens, count(*) AS n_distinct FROM b GROUP BY 1""",
    "text_normalize": f"SELECT doc_id, length({_NORM}) AS chars, sha256({_NORM}) AS sha256 FROM documents",
    "iso_date_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN strftime(o_orderdate, '%-d. %b') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
    "table_grid_pipes": f"""WITH {_PIPES} SELECT doc_id, count(*) AS n_rows, max(len(cells)) AS width, min(len(cells)) = max(len(cells)) AS uniform, sum(len(list_filter(cells, lambda c: c <> '')))::BIGINT AS filled,
round(1 - sum(len(list_filter(cells, lambda c: c <> ''))) / (count(*) * max(len(cells))), 6) AS empty_density FROM p GROUP BY doc_id""",
    "markdown_valid": f"WITH {_PIPES} SELECT doc_id, run::INT AS run, count(*) AS n_rows, max(len(cells)) AS width, min(len(cells)) = max(len(cells)) AS uniform FROM r GROUP BY doc_id, run",
    "table_continuation": f"""WITH {_PIPES}, f AS (SELECT doc_id, run::INT AS run, max(len(cells)) AS width, count(*) AS n_rows FROM r GROUP BY ALL),
g AS (SELECT *, coalesce(lag(width) OVER (PARTITION BY doc_id ORDER BY run) = width, false) AS continues FROM f)
SELECT *, (sum((NOT continues)::INT) OVER (PARTITION BY doc_id ORDER BY run))::INT AS logical_table FROM g""",
    "horizontal_compose": """WITH a AS (SELECT n_name AS name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name),
b AS (SELECT n_name AS name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY n_name)
SELECT coalesce(a.name, lower(b.name)) AS name, customers, suppliers FROM a FULL JOIN b ON a.name = b.name""",
    "distribution_audit": "SELECT source, count(*) AS n, min(n_chars) AS chars_min, quantile_cont(n_chars, 0.5) AS chars_median, quantile_disc(n_chars, 0.95)::DOUBLE AS chars_p95, max(n_chars) AS chars_max FROM documents GROUP BY source",
    "regression_diff": f"""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'es'), n AS (SELECT doc_id, sha256({_NORM}) AS h FROM documents WHERE lang <> 'de')
SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.h = n.h THEN 'equal' ELSE 'changed' END AS status, count(*) AS documents FROM o FULL JOIN n USING (doc_id) GROUP BY 1""",
    "release_inventory": """WITH k AS (SELECT unnest(['en', 'fr', 'de', 'es', 'it']) AS kind), f AS (SELECT source, lang AS kind, sha256(min(doc_id) || ',' || max(doc_id) || ',' || count(*)) AS sha256 FROM documents GROUP BY ALL)
SELECT w.source, w.kind, sha256, sha256 IS NOT NULL AS present FROM (SELECT source, kind FROM (SELECT DISTINCT source FROM documents) CROSS JOIN k) w LEFT JOIN f ON f.source = w.source AND f.kind = w.kind""",
    "embedding_text": "SELECT p_partkey, p_name || ' for Parts — Brand was ' || p_brand || '. ' || p_name || ' for Parts — Type was ' || p_type || '. ' || p_name || ' for Parts — Size was ' || p_size || '.' AS text FROM part",
    "upsert_latest": """WITH k AS (SELECT min(event_type) AS low, max(event_type) AS high FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events, k WHERE event_type = low),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events, k WHERE event_type = high)
SELECT user_id, event_id, event_type, value FROM b WHERE n = 1 UNION ALL SELECT user_id, event_id, event_type, value FROM a WHERE n = 1 AND user_id NOT IN (SELECT user_id FROM b)""",
    "company_rollup": "SELECT source, lang, grouping(source, lang)::INT AS level, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)",
    "title_audit": r"""WITH t AS (SELECT string_split(coalesce(text, ''), chr(10))[1] AS title FROM documents),
v AS (SELECT unnest([CASE WHEN trim(title) = '' THEN 'missing' END, CASE WHEN length(title) > 500 THEN 'overlong' END, CASE WHEN regexp_matches(title, '^(?:[A-Za-z]-)?\d{1,3}$') THEN 'page_label' END, CASE WHEN regexp_matches(title, ' (?:of|for|the|and|to|in|by)$') THEN 'truncated' END]) AS rule FROM t)
SELECT rule, count(*) AS documents FROM v WHERE rule IS NOT NULL GROUP BY rule""",
}
