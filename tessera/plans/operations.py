"""Sources, sinks, reports, checks and releases, each run over the driver's tables and read back from what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import cells
from tessera.operators import artifacts, audit, chunker, compose, metrics, migration, providers, release
from tessera.plans import evaluation, filings
from tessera.plans import retrieval as R
from tessera.sources import tables as sources
from tessera.sources.store import fresh
from tessera.sources.tables import table


def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as JSON lines and read back under a strict schema."""
    rows = table(spark, sf, "customer").withColumn("c_acctbal", F.round("c_acctbal", 2))
    path = artifacts.write_jsonl(rows, fresh(spark, "customers"))
    return sources.required_rows(sources.read_jsonl(spark, path, rows.schema), path)


def jsonl_bad_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A file of questions in which each line whose number divides by 7 is no object: the lines are named."""
    items = table(spark, sf, "benchmark").select("item_id").orderBy("item_id").limit(200)  # one small file of questions
    lines = [f"question {r.item_id}" if (i + 1) % 7 == 0 else f'{{"question": "q{r.item_id}"}}' for i, r in enumerate(items.collect())]
    folder = fresh(spark, "questions")
    release.Store(spark, folder).write("questions.jsonl", "\n\n".join(lines) + "\n")
    return sources.read_jsonl_errors(spark, f"{folder}/questions.jsonl", T.StructType([T.StructField("question", T.StringType())])).select(F.col("line").cast("long").alias("line"), "line_text")


def file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """A file a region, copied whole, and the SHA-256 of its bytes."""
    folder = fresh(spark, "files")
    store = release.Store(spark, folder)
    for r in table(spark, sf, "region").collect():  # five rows
        store.write(f"draft-{r.r_regionkey}", f"{r.r_regionkey}:{r.r_name}\n")
        store.copy(f"{folder}/draft-{r.r_regionkey}", f"region-{r.r_regionkey}.txt")
        store.delete(f"draft-{r.r_regionkey}")
    return artifacts.file_hashes(spark, folder, prefixed=True)


def vector_artifact(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with ids and text hashes, written, read back and described."""
    chunks = table(spark, sf, "embeddings").select(F.concat(F.lit("c"), F.col("vec_id")).alias("chunk_id"), F.concat(F.lit("text "), F.col("label")).alias("text"), "embedding")
    return artifacts.vector_manifest(spark.read.parquet(artifacts.write_vectors(chunks, fresh(spark, "vectors"))))


def embedding_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors damaged by rule (lost, cut, scaled, not a number, stale), and how many the release audit finds of each."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("text "), F.col("label")).alias("text"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    at = lambda n: F.col("chunk_id") % 11 == n
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("embedding", lambda x: x / norm)
    damaged = rows.filter(~at(1)).select(
        "chunk_id", F.when(at(2), F.slice(unit, 1, F.size(unit) - 1)).when(at(3), F.transform(unit, lambda x: x * 2)).when(at(4), F.transform(unit, lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x))).otherwise(unit).alias("embedding"),
        F.sha2(F.when(at(5), F.lit("old")).otherwise(F.col("text")), 256).alias("text_sha256"),
    )
    width = rows.select(F.max(F.size("embedding"))).first()[0]
    found = audit.embedding_violations(damaged, rows.select("chunk_id", "text"), width)
    return found.filter((F.col("rule") != "not_unit") | at(3)).groupBy("rule").agg(F.count(F.lit(1)).alias("vectors"))


def run_results(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of each question with the facts of the run, as JSON lines, read back."""
    per = metrics.per_query(evaluation.gold(spark, sf), evaluation._run(spark, sf), "doc_id", (1, 10))
    rows = artifacts.with_metadata(per, {"retriever": "bm25", "top_k": 30, "n_gold": -1})
    path = artifacts.write_jsonl(rows, fresh(spark, "results"))
    return sources.read_jsonl(spark, path, rows.schema)


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Means overall, by question type and by company, as rows of (scope, name, JSON)."""
    per = evaluation._typed(spark, sf)
    found = metrics.grouped(per, [[], ["question_type"], ["company"]], ["recall_at_10", "mrr_at_10"])
    scope = F.when(F.col("question_type").isNotNull(), "question_type").when(F.col("company").isNotNull(), "company").otherwise("overall")
    return found.select(scope.alias("scope"), F.coalesce("question_type", "company").alias("name"), "n_queries", "recall_at_10", "mrr_at_10")


def newest_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file a customer and year of order: the newest of each."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("raw/C"), F.col("o_custkey"), F.lit("/"), F.year("o_orderdate"), F.when(F.col("o_orderkey") % 5 == 0, "-10-K.txt.gz").otherwise("-10-K.html")).alias("path"))
    other = table(spark, sf, "customer").select(F.concat(F.lit("raw/C"), F.col("c_custkey"), F.lit("/9999-8-K.html")).alias("path"))
    found = sources.newest_filings(o.filter("path LIKE '%html'").distinct().unionByName(other))
    return found.select("ticker", "filing_year", "path")


def duplicate_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that more than one region's folder would claim, by the first two letters of the region."""
    return sources.duplicate_tickers(table(spark, sf, "customer").select(F.concat("c_nationkey", F.lit("-"), F.substring("c_mktsegment", 1, 2)).alias("ticker")))


def recent_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The first entry of the wanted form in each customer's parallel arrays of submissions."""
    o = table(spark, sf, "orders").select("o_custkey", F.struct(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-K/A").otherwise("8-K").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).alias("x"))
    rows = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    number = lambda prefix: F.transform("xs", lambda x: F.concat(F.lit(prefix), x["k"].cast("string")))
    recent = F.struct(F.transform("xs", lambda x: x["form"]).alias("form"), number("A-").alias("accessionNumber"), F.transform("xs", lambda x: x["d"]).alias("filingDate"), number("doc").alias("primaryDocument"))
    found = sources.recent_form(rows.select("o_custkey", recent.alias("recent")))
    return found.select("o_custkey", F.col("newest.accessionNumber").alias("accession"), F.col("newest.filingDate").alias("filed"), F.col("newest.primaryDocument").alias("document"))


def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A Markdown report of chunk lengths by source, and the rows read back from it."""
    rows = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))
    text = artifacts.report(rows, "Sources", {"Source": F.col("source"), "Documents": artifacts.format_count(F.col("documents")), "Size": artifacts.format_bytes(F.col("chars"))}, [F.col("source")])
    folder = fresh(spark, "report")
    store = release.Store(spark, folder)
    store.write("report.md", text)
    held = spark.read.text(f"{folder}/report.md", wholetext=True).select(F.explode(F.split("value", "\n")).alias("line")).filter("line LIKE '| src%'")
    lines = held.select(F.regexp_extract("line", r"^\| (\S+)", 1).alias("source"), "line")
    return artifacts.report_rows(spark, store.read("report.md"), "source string, documents long, chars long").join(lines, "source")


def formatted_values(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds, sizes, counts and shares as a report shows them."""
    e = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).cast("long").alias("v"), F.count_if(F.col("value") > 50).alias("high"))
    return e.select("event_type", artifacts.format_seconds(F.col("v") / 8).alias("seconds"), artifacts.format_bytes(F.col("v") * 4096).alias("size"), artifacts.format_count(F.col("n") * 1000).alias("count_text"), artifacts.percentage(F.col("high") / F.col("n")).alias("share"))


def config_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Chunking settings made from parts: which rules each breaks, and the hash of those that fit."""
    settings = table(spark, sf, "part").select(
        "p_partkey", F.lit(3).alias("schema_version"), F.when(F.col("p_size") % 7 == 0, 1).otherwise(2).alias("table_schema_version"), (F.col("p_size") * 10).alias("chunk_size"),
        (F.col("p_partkey") % 400).cast("int").alias("chunk_overlap"), F.when(F.col("p_partkey") % 3 == 0, "fixed").when(F.col("p_partkey") % 17 == 1, "other").otherwise("recursive").alias("strategy"), F.lit("tokens").alias("length_function"),
    )
    return chunker.config_violations(settings, "p_partkey")


def prepared_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Queries and documents with the prefixes of each model."""
    rows = table(spark, sf, "benchmark").select("item_id", "text")
    parts = [rows.select("item_id", F.lit(n).alias("model"), F.sha2(providers.prepared(F.col("text"), n, "query"), 256).alias("query_sha256"), F.sha2(providers.prepared(F.col("text"), n, "document"), 256).alias("document_sha256")) for n in sorted(providers.MODELS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filing_embedding_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What each stacked table of the filings is embedded by."""
    found = compose.compose_tables(filings.blocks(spark, sf)).filter("mode = 'vertical'")
    text = artifacts.embedding_text(found, company=F.concat(F.lit("C"), F.col("doc").cast("string")), section=F.lit("Item 8"), region=F.lit("financial_statements"))
    return found.select("doc", text.alias("text"))


def filing_table_values(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the side-by-side tables as rows, with what they hold by the expression ladder."""
    found = compose.compose_tables(filings.blocks(spark, sf)).filter("mode = 'horizontal'")
    rows = artifacts.table_cells(found, ["doc"]).filter("column > 0")
    return rows.select("doc", F.col("row").cast("int").alias("row"), F.col("column").cast("int").alias("col"), "header", "value", cells.kind(F.col("value")).alias("kind"))


def generation_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The five best documents of each item as sources to cite."""
    hits = R.bm25_topk(spark, sf).filter("rank <= 5").select("qid", "rank", "doc_id").join(table(spark, sf, "documents").select("doc_id", "source", "lang", F.substring("text", 1, 200).alias("text")), "doc_id")
    return artifacts.context_blocks(hits, "qid", "rank", "doc_id", ["source", "lang"], "text").select("qid", F.sha2("context", 256).alias("context_sha256"), F.length("context").alias("chars"))


def rerank_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """What a reranker reads of each document; those of one source count as tables."""
    d = table(spark, sf, "documents")
    kind = F.when(F.col("source") == "src1", "table").otherwise("narrative")
    return d.select("doc_id", F.sha2(artifacts.rerank_text(F.col("source"), F.lit(None).cast("string"), F.col("lang"), kind, F.col("text"), F.concat(F.lit("n "), F.col("n_chars"))), 256).alias("sha256"))


def gold_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of each passage's gold documents, joined in order."""
    rows = evaluation.gold(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("qid", F.struct("doc_id", "text").alias("x"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "\n\n")
    return rows.groupBy("qid").agg(F.count(F.lit(1)).alias("documents"), F.sha2(joined, 256).alias("answer_sha256"))


def evidence_migration(spark: SparkSession, sf: str) -> DataFrame:
    """Old labels on conversation turns matched to chunks of two turns each."""
    turns = table(spark, sf, "conversations").filter("conv_id % 10 = 3").withColumn("text", F.coalesce("text", F.lit("")))
    block = F.concat_ws("-", "conv_id", "turn")
    evidence = turns.filter("turn % 3 = 1").select(block.alias("evidence_id"), F.array(block).alias("block_ids"), F.lit("narrative").alias("content_type"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("zz9 "), F.col("text"))).alias("text"), F.lit(None).cast("string").alias("logical_table_id"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("pair", F.floor((F.row_number().over(w) - 1) / 2)).groupBy("conv_id", "pair").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    chunks = pairs.select(F.concat_ws("-", F.lit("c"), "conv_id", "pair").alias("chunk_id"), F.transform("ts", lambda t: F.concat_ws("-", F.col("conv_id"), t["turn"])).alias("block_ids"), F.lit("narrative").alias("content_type"), F.array_join(F.transform("ts", lambda t: t["text"]), "\n\n").alias("text"), F.lit(None).cast("string").alias("logical_table_id"))
    return migration.match_evidence(evidence, chunks).groupBy("method").agg(F.count(F.lit(1)).alias("evidence"), F.count("chunk_id").alias("matched"))


def released_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two releases of region and nation, then the first again: what readers are pointed to each time."""
    folder = fresh(spark, "release")
    tables = {n: table(spark, sf, n) for n in ("region", "nation")}
    seen = []
    for label, action in (("first", lambda: release.promote(spark, folder, tables, "r1", [])), ("second", lambda: release.promote(spark, folder, {n: df.limit(3) for n, df in tables.items()}, "r2", [])), ("back", lambda: release.roll_back(spark, folder))):
        action()
        now = release.current(spark, folder)
        seen += [(label, now["release_id"], now["version"], n, rows) for n, rows in now["rows"].items()]
    return spark.createDataFrame(seen, "step string, release_id string, version string, name string, n_rows long")


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_round_trip, jsonl_bad_lines, file_digests, vector_artifact, embedding_faults, run_results, run_summary, newest_files, duplicate_artifacts, recent_forms, report_round_trip, formatted_values,
        config_faults, prepared_texts, filing_embedding_texts, filing_table_values, generation_contexts, rerank_inputs, gold_answers, evidence_migration, released_tables,
    )
}

_F = filings
_TOKENS = r"regexp_extract_all(lower(%s), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')"
ORACLE_SQL = {
    "jsonl_round_trip": "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer",
    "jsonl_bad_lines": "SELECT 2 * k - 1 AS line, 'question ' || item_id AS line_text FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS k FROM benchmark) WHERE k % 7 = 0 AND k <= 200",
    "file_digests": "SELECT 'region-' || r_regionkey || '.txt' AS name, strlen(r_regionkey || ':' || r_name || chr(10))::BIGINT AS bytes, 'sha256:' || sha256(r_regionkey || ':' || r_name || chr(10)) AS sha256 FROM region",
    "vector_artifact": "SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, min(len(embedding))::INT AS width_min, max(len(embedding))::INT AS width_max, sum(('0x' || substr(sha256('c' || vec_id || '|' || sha256('text ' || label)), 1, 12))::BIGINT)::VARCHAR AS digest FROM embeddings",
    "embedding_faults": """WITH v AS (SELECT vec_id % 11 AS m FROM embeddings)
SELECT * FROM (SELECT unnest(['missing', 'width', 'not_finite', 'not_unit', 'stale_text']) AS rule, unnest([count_if(m = 1), count_if(m IN (1, 2)), count_if(m IN (1, 4)), count_if(m = 3), count_if(m IN (1, 5))]) AS vectors FROM v) WHERE vectors > 0""",
    "run_results": evaluation._per((1, 10)) + " SELECT per.*, 'bm25' AS retriever, 30 AS top_k FROM per",
    "run_summary": evaluation._per((1, 10, 30)) + """, t AS (SELECT *, CASE WHEN qid % 2 = 0 THEN 'single_narrative' ELSE 'single_table' END AS question_type, (qid % 5)::VARCHAR AS company FROM per)
SELECT CASE WHEN question_type IS NOT NULL THEN 'question_type' WHEN company IS NOT NULL THEN 'company' ELSE 'overall' END AS scope, coalesce(question_type, company) AS name, count(*) AS n_queries, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(mrr_at_10), 6) AS mrr_at_10
FROM t GROUP BY GROUPING SETS ((), (question_type), (company))""",
    "newest_files": "SELECT 'C' || o_custkey AS ticker, max(year(o_orderdate))::INT AS filing_year, 'raw/C' || o_custkey || '/' || max(year(o_orderdate)) || '-10-K.html' AS path FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_custkey",
    "duplicate_artifacts": "SELECT c_nationkey || '-' || substr(c_mktsegment, 1, 2) AS ticker, count(*) AS files FROM customer GROUP BY 1 HAVING count(*) > 1",
    "recent_forms": """SELECT c.o_custkey, 'A-' || k AS accession, strftime(d, '%Y-%m-%d') AS filed, 'doc' || k AS document FROM (SELECT DISTINCT o_custkey FROM orders) c
LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k, min_by(o_orderdate, o_orderkey) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) USING (o_custkey)""",
    "report_round_trip": """SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars, format('| {} | {:,} | {:.1f} MiB |', source, count(*), sum(n_chars) / 1048576.0) AS line FROM documents GROUP BY source""",
    "formatted_values": """WITH e AS (SELECT event_type, count(*) AS n, sum(floor(value))::BIGINT AS v, count_if(value > 50) AS high FROM events GROUP BY event_type)
SELECT event_type, printf('%.2f s', v / 8) AS seconds, printf('%.1f MiB', v * 4096 / 1048576) AS size, format('{:,}', n * 1000) AS count_text, printf('%.1f%%', 100 * (high / n)) AS share FROM e""",
    "config_faults": """WITH c AS (SELECT p_partkey, p_size % 7 = 0 AS t, p_size * 10 AS size, p_partkey % 400 AS o, p_partkey % 3 <> 0 AND p_partkey % 17 = 1 AS s FROM part),
v AS (SELECT p_partkey, unnest([CASE WHEN t THEN 'table_schema_version' END, CASE WHEN s THEN 'strategy' END, CASE WHEN o >= size THEN 'chunk_overlap' END]) AS rule FROM c) SELECT * FROM v WHERE rule IS NOT NULL""",
    "prepared_texts": "WITH m AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{m['query_prefix']}', '{m['document_prefix']}')" for n, m in providers.MODELS.items()) + ") t(model, q, d)) SELECT item_id, model, sha256(q || coalesce(text, '')) AS query_sha256, sha256(d || coalesce(text, '')) AS document_sha256 FROM benchmark, m",
    "filing_embedding_texts": _F._from_templates([("\n".join([
        "Company: C{key}", "Section: Item 8", "Document region: Financial Statements", "Title: Order values", "Column units: text | usd | usd", "Headers:", f"Header context: {_F._YEAR}", "Line item", *map(str, _F.YEARS), "Table values:",
        *[f"{r[0]} for {_F._YEAR} — {y} was {v}." for r in _F._F1_ROWS + _F._F2_ROWS for y, v in zip(_F.YEARS, r[1:])],
    ]),)], ["text"]),
    "filing_table_values": _F._from_templates([(r, c, _F._WIDE[c], v, "{kind" + v.strip("${}") + "}") for r, row in enumerate(_F._WIDE_ROWS) for c, v in enumerate(row) if c], ["row", "col", "header", "value", "kind"]),
    "generation_contexts": f"""WITH {R.BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored),
b AS (SELECT qid, rank, format('<source id="{{}}" source={{}}; lang={{}}>', doc_id, source, coalesce(lang, 'unknown')) || chr(10) || substr(coalesce(text, ''), 1, 200) || chr(10) || '</source>' AS b FROM r JOIN documents USING (doc_id) WHERE rank <= 5),
c AS (SELECT qid, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY qid) SELECT qid, sha256(context) AS context_sha256, length(context)::INT AS chars FROM c""",
    "rerank_inputs": """SELECT doc_id, sha256('Company: ' || coalesce(source, '') || chr(10) || 'Ticker: ' || chr(10) || 'Section: ' || coalesce(lang, '') || chr(10) || 'Content type: ' || CASE WHEN source = 'src1' THEN 'table' ELSE 'narrative' END || chr(10) || chr(10)
|| CASE WHEN source = 'src1' THEN 'n ' || n_chars || chr(10) || chr(10) || 'Full table:' || chr(10) ELSE '' END || coalesce(text, '')) AS sha256 FROM documents""",
    "gold_answers": f"WITH {evaluation.GOLD} SELECT qid, count(*) AS documents, sha256(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS answer_sha256 FROM gold JOIN documents USING (doc_id) GROUP BY qid",
    "released_tables": """WITH n AS (SELECT 'region' AS name, count(*) AS c FROM region UNION ALL SELECT 'nation', count(*) FROM nation)
SELECT step, release_id, version, name, CASE WHEN step = 'second' THEN least(c, 3) ELSE c END AS n_rows FROM n, (VALUES ('first', 'r1', 'v1'), ('second', 'r2', 'v2'), ('back', 'r1', 'v1')) s(step, release_id, version)""",
    "evidence_migration": f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS pair FROM conversations WHERE conv_id % 10 = 3),
c AS (SELECT conv_id, pair, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM t GROUP BY ALL),
e AS (SELECT t.conv_id, t.pair, CASE WHEN turn % 2 = 0 THEN text ELSE 'zz9 ' || text END AS q FROM t WHERE turn % 3 = 1),
k AS (SELECT replace(lower(trim(regexp_replace(q, '\\s+', ' ', 'g'))), 'ß', 'ss') AS q, replace(lower(trim(regexp_replace(body, '\\s+', ' ', 'g'))), 'ß', 'ss') AS body FROM e JOIN c USING (conv_id, pair)),
o AS (SELECT contains(body, q) AS exact, list_distinct({_TOKENS % "q"}) AS want, {_TOKENS % "body"} AS got FROM k),
m AS (SELECT CASE WHEN exact THEN 'exact' WHEN len(want) = 0 OR round(len(list_intersect(want, got)) / len(want), 6) >= 0.6 THEN 'token_overlap' ELSE 'unresolved' END AS method FROM o)
SELECT method, count(*) AS evidence, CASE WHEN method = 'unresolved' THEN 0 ELSE count(*) END AS matched FROM m GROUP BY method""",
}
