"""Chunking queries: conversations are ordered blocks, documents are bodies to be cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import ordered_digest, tokens
from tessera.jobs import CONFIG
from tessera.operators import audit, chunker, chunking
from tessera.operators.html import html_blocks
from tessera.sources.tables import table

SIZE, OVERLAP = 500, 32


def _islands(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.islands(table(spark, sf, "conversations"), "conv_id", "turn", [F.col("role")], F.col("role") == "system")


def narrative_islands(spark: SparkSession, sf: str) -> DataFrame:
    rows = _islands(spark, sf).groupBy("conv_id", "island", "role").agg(F.count(F.lit(1)).alias("blocks"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))
    return chunking.chunk_ids(rows, "conv_id", ["island"])


def chunk_fixed_spans(spark: SparkSession, sf: str) -> DataFrame:
    spans = chunking.fixed_spans(table(spark, sf, "documents"), "doc_id", "text", SIZE, OVERLAP)
    return spans.select("doc_id", "span", "token_start", "token_end", F.sha2(F.array_join("span_tokens", " "), 256).alias("tokens_sha256"))


def chunk_recursive_spans(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.recursive_spans(table(spark, sf, "documents"), "doc_id", "text", SIZE, OVERLAP)


def chunk_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Which turns each window of 1,000 characters of a conversation (turns joined by a blank line) comes from."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    blocks = chunking.block_offsets(turns, "conv_id", "turn", F.col("n"))
    body = blocks.groupBy("conv_id").agg(F.max("block_end").alias("total"))
    spans = body.select("conv_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("total") / 900) - 1).cast("int"))).alias("span"), "total")
    spans = spans.select("conv_id", "span", (F.col("span") * 900).cast("long").alias("start"), F.least(F.col("span") * 900 + 1000, F.col("total")).cast("long").alias("end"))
    return chunking.provenance(spans, blocks, "conv_id", bucket=1024).select("conv_id", "span", "start", "end", "turn", "block_start", "block_end")


def chunk_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    spans = chunking.fixed_spans(table(spark, sf, "documents"), "doc_id", "text", SIZE, OVERLAP)
    return chunking.overlaps(spans, "doc_id", "span").select("doc_id", "span", "overlap_tokens")


def chunk_statistics(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return chunking.statistics(docs.withColumn("tokens", F.size(tokens(F.col("text")))), "tokens", "text", "source")


def coverage_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of conversations that a chunk of an assistant run came from."""
    used = _islands(spark, sf).filter("role = 'assistant'").select("conv_id", "turn")
    return chunking.coverage(used, table(spark, sf, "conversations"), ["conv_id", "turn"])


def ordered_hash_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of the ordered block hashes of each conversation, and their count."""
    rows = table(spark, sf, "conversations").withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("blocks"), ordered_digest(F.col("h"), F.col("turn")).alias("digest"))


def lineage_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose documents carry more than one value of what must be single (here the language)."""
    rows = table(spark, sf, "documents").groupBy("source").agg(F.count_distinct("lang").alias("values"), F.min("lang").alias("low"), F.max("lang").alias("high"))
    return rows.withColumn("consistent", F.col("values") == 1)


def bounded_lookback_title(spark: SparkSession, sf: str) -> DataFrame:
    """For each assistant turn the nearest user turn of at most 200 characters within six turns before it."""
    short = F.when((F.col("role") == "user") & (F.length("text") <= 200), F.struct("turn", "text"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    rows = table(spark, sf, "conversations").withColumn("title", F.last(short, ignorenulls=True).over(w))
    return rows.filter("role = 'assistant'").select("conv_id", "turn", F.col("title.turn").alias("title_turn"), F.sha2(F.col("title.text"), 256).alias("title_sha256"))


def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages to blocks to chunks of the production size."""
    blocks = html_blocks(table(spark, sf, "pages"))
    return chunker.chunk_blocks(blocks, CONFIG).select("doc", "chunk_id", "content_type", "section", "n_tokens", "block_ids", F.sha2("text", 256).alias("text_sha256"))


def page_report(spark: SparkSession, sf: str) -> DataFrame:
    """Block counts of every page and of the corpus."""
    return audit.filing_report(html_blocks(table(spark, sf, "pages")))


QUERIES = {
    f.__name__: f
    for f in (
        narrative_islands, chunk_fixed_spans, chunk_recursive_spans, chunk_provenance, chunk_overlaps, chunk_statistics, coverage_ratio, ordered_hash_digest,
        lineage_consistency, bounded_lookback_title, page_chunks, page_report,
    )
}

TOKENS = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')"
SPANS = f"""t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
s AS (SELECT doc_id, t, unnest(range(0, 1 + greatest(0, ceil((len(t) - {SIZE}) / {SIZE - OVERLAP}))::INT)) AS span FROM t WHERE len(t) > 0),
spans AS (SELECT doc_id, span, span * {SIZE - OVERLAP} AS token_start, least(span * {SIZE - OVERLAP} + {SIZE}, len(t)) AS token_end, t[span * {SIZE - OVERLAP} + 1:span * {SIZE - OVERLAP} + {SIZE}] AS x FROM s)"""
ISLANDS = """o AS (SELECT *, role = 'system' AS out, lag(role) OVER w AS before, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum((NOT out AND (k = 1 OR before = 'system' OR before <> role))::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM o)"""

ORACLE_SQL = {
    "narrative_islands": f"""WITH {ISLANDS}, g AS (SELECT conv_id, island, role, count(*) AS blocks, min(turn) AS first_turn, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars FROM i WHERE NOT out GROUP BY ALL)
SELECT conv_id, island::INT AS island, role, blocks, first_turn, last_turn, chars, format('{{}}-CHUNK-{{:06d}}', conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY island)) AS chunk_id FROM g""",
    "chunk_fixed_spans": f"WITH {SPANS} SELECT doc_id, span, token_start, token_end, sha256(array_to_string(x, ' ')) AS tokens_sha256 FROM spans",
    "chunk_provenance": """WITH b AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, coalesce(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_start FROM conversations),
e AS (SELECT *, block_start + n AS block_end FROM b), m AS (SELECT conv_id, max(block_end) AS total FROM e GROUP BY conv_id),
s AS (SELECT conv_id, total, unnest(range(0, 1 + greatest(0, ceil(total / 900) - 1)::INT)) AS span FROM m),
w AS (SELECT conv_id, span, span * 900 AS start, least(span * 900 + 1000, total) AS "end" FROM s)
SELECT conv_id, span, start, "end", turn, block_start, block_end FROM w JOIN e USING (conv_id) WHERE block_end > start AND block_start < "end" """,
    "chunk_overlaps": f"WITH {SPANS} SELECT doc_id, span, greatest(0, coalesce(lag(token_end) OVER (PARTITION BY doc_id ORDER BY span) - token_start, 0)) AS overlap_tokens FROM spans",
    "chunk_statistics": f"""WITH t AS (SELECT source, len({TOKENS}) AS n, text FROM documents)
SELECT source, count(*) AS chunks, min(n) AS length_min, round(avg(n), 6) AS length_mean, quantile_cont(n, 0.5) AS length_median, quantile_disc(n, 0.95)::DOUBLE AS length_p95, max(n) AS length_max,
  round(avg(regexp_matches(rtrim(text, ' '), '[.!?:;]$')::INT), 6) AS boundary_accuracy FROM t GROUP BY source""",
    "coverage_ratio": "SELECT count(*) AS blocks, count_if(role = 'assistant') AS covered, round(count_if(role = 'assistant') / count(*), 6) AS coverage FROM conversations",
    "ordered_hash_digest": "SELECT conv_id, count(*) AS blocks, sha256(string_agg(sha256(coalesce(text, '')) || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "lineage_consistency": "SELECT source, count(DISTINCT lang) AS \"values\", min(lang) AS low, max(lang) AS high, count(DISTINCT lang) = 1 AS consistent FROM documents GROUP BY source",
    "bounded_lookback_title": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
l AS (SELECT a.conv_id, a.turn, max_by(b.turn, b.k) AS title_turn, max_by(b.text, b.k) AS title FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.k BETWEEN a.k - 6 AND a.k - 1 AND b.role = 'user' AND length(b.text) <= 200 WHERE a.role = 'assistant' GROUP BY 1, 2)
SELECT conv_id, turn, title_turn, sha256(title) AS title_sha256 FROM l""",
}
