"""Retrieval queries over the driver's tables: documents are chunks, benchmark items are questions, labels are companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import bm25, dense, fusion, retrieve, scope
from tessera.operators.providers import OverlapScorer, rerank
from tessera.sources.store import once, version
from tessera.sources.tables import table

# In the synthetic texts a function word of each language stands in for a company's name.
ALIASES = {"EN": ["the", "of the"], "FR": ["que", "est"], "DE": ["der", "die"], "ES": ["los", "del"]}
SOURCES = {"src0": ["the"], "src1": ["que"], "src2": ["der"], "src3": ["los", "with"]}
CUES = ["from the", "pour les", "mit der"]
ENUMERATION = [r"\bwho (?:the|of|is)\b", r"\bthat (?:of|the)\b"]


def index(spark: SparkSession, sf: str) -> bm25.Index:
    """The BM25 index of `documents`, built once a Spark application and again if the table changes."""
    path = f"{sf}/documents.parquet"
    return once(spark, ("bm25", path, version(spark, path)), lambda: bm25.build(table(spark, sf, "documents")))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, doc_id, score, share) of benchmark items against all documents."""
    return bm25.scores(table(spark, sf, "benchmark"), index(spark, sf))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.top(scores(spark, sf), 10).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_scoped_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    """Global statistics, then only rows of the allowed sources, then the cut."""
    allowed = table(spark, sf, "documents").filter(F.col("source").isin("src0", "src3", "src7")).select("doc_id", "source")
    return bm25.top(scores(spark, sf).join(allowed, "doc_id"), 10).select("qid", "doc_id", "source", F.round("score", 6).alias("score"), "rank")


def bm25_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.term_stats(index(spark, sf)).withColumn("idf", F.round("idf", 6))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), "embedding", "label")


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = dense.top(_queries(spark, sf), table(spark, sf, "embeddings"), 10)
    return found.withColumn("score", F.round("score", 6))


def dense_scoped_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    found = dense.top(_queries(spark, sf), table(spark, sf, "embeddings"), 10, group="label", same_group=True)
    return found.withColumn("score", F.round("score", 6))


def dense_two_pool_union(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    everywhere = dense.top(_queries(spark, sf), vectors, 30)
    typed = dense.top(_queries(spark, sf), vectors.filter("label % 2 = 0"), 10)
    return dense.two_pools(everywhere, typed, "vec_id")


def vector_norm_audit(spark: SparkSession, sf: str) -> DataFrame:
    return dense.norm_audit(table(spark, sf, "embeddings"))


def term_overlap_ranks(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """A second ranked list (qid, doc_id, score, rank): by the share of an item's distinct terms that a document has."""
    return bm25.top(scores(spark, sf).select("qid", "doc_id", F.col("share").alias("score")), k)


def _two_lists(spark: SparkSession, sf: str, k: int = 30) -> tuple[DataFrame, DataFrame]:
    return term_overlap_ranks(spark, sf, k), bm25.top(scores(spark, sf).drop("share"), k)


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    fused = fusion.rrf(list(_two_lists(spark, sf)), "doc_id", top_k=30)
    return fused.withColumn("rrf", F.round("rrf", 9))


def hybrid(spark: SparkSession, sf: str, k: int = 30) -> DataFrame:
    return fusion.hybrid_ranks(*_two_lists(spark, sf, k), "doc_id")


def hybrid_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid(spark, sf).withColumn("rrf", F.round("rrf", 9))


def _with_source(fused: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return fused.join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")


def anchored_merge(spark: SparkSession, sf: str) -> DataFrame:
    fused = _with_source(hybrid(spark, sf), spark, sf)
    anchored = fused.filter(F.col("source").isin("src0", "src1", "src2")).withColumn("rank", F.row_number().over(Window.partitionBy("qid", "source").orderBy("rank")))
    return fusion.anchored_merge(fused, anchored, "doc_id", "source", top_k=10, each=3)


def enumeration_select(spark: SparkSession, sf: str) -> DataFrame:
    chosen = fusion.enumeration_select(_with_source(hybrid(spark, sf), spark, sf), "doc_id", "source", top_k=10)
    return chosen.select("qid", "doc_id", "source", "rank", "representative", F.round("rrf", 9).alias("rrf"))


def _subqueries(spark: SparkSession, sf: str) -> DataFrame:
    """Items in threes are the sub-queries of one request."""
    fused = hybrid(spark, sf).filter("rank <= 10")
    return fused.select(F.floor(F.col("qid") / 3).cast("long").alias("request"), F.col("qid").alias("sub"), "doc_id", "rrf", "rank").withColumnRenamed("request", "qid")


def context_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = fusion.context_merge(_subqueries(spark, sf), "doc_id")
    return merged.select("qid", "doc_id", F.round("best_rrf", 9).alias("best_rrf"), "n_subqueries", F.round("selection_score", 9).alias("selection_score"), "position", F.array_join(F.transform("subqueries", lambda x: x.cast("string")), ",").alias("subqueries"))


def context_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.context_coverage(_subqueries(spark, sf), "doc_id")


def scope_detect(spark: SparkSession, sf: str) -> DataFrame:
    rows = scope.with_scope(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", ALIASES, CUES, ENUMERATION)
    return rows.select("conv_id", "turn", F.array_join("companies", ",").alias("companies"), "scope")


def scope_aware_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item answered by the branch of its scope; sources stand in for companies."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    asked = scope.with_scope(items, "text", SOURCES, CUES, ENUMERATION).select("qid", "scope", "companies")
    found = scores(spark, sf)
    overlap, lexical = found.select("qid", "doc_id", F.col("share").alias("score")), found.select("qid", "doc_id", "score")
    return retrieve.scope_aware(asked, overlap, lexical, table(spark, sf, "documents"), "doc_id", "source", top_k=10)


def rerank_stub(spark: SparkSession, sf: str) -> DataFrame:
    """The hybrid pool ordered by a deterministic stand-in for a cross-encoder."""
    pool = hybrid(spark, sf, 30).filter("rank <= 30").select("qid", "doc_id", F.col("rank").alias("pool_rank"))
    pairs = pool.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")), "qid")
    return rerank(pairs, OverlapScorer(), "doc_id", 10).select("qid", "doc_id", "pool_rank", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_scoped_postfilter, bm25_index_stats, dense_topk, dense_scoped_prefilter, dense_two_pool_union, vector_norm_audit, rrf_fusion,
        hybrid_ranks, scope_detect, anchored_merge, enumeration_select, context_merge, context_coverage, rerank_stub, scope_aware_retrieval,
    )
}

STOP = "['a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with']"
TERMS = rf"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({STOP}, w))"

BM25 = f"""
d AS (SELECT doc_id, {TERMS} AS terms FROM documents),
facts AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avgdl FROM d),
asked AS (SELECT DISTINCT item_id AS qid, unnest({TERMS}) AS term FROM benchmark),
tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT qid, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), facts GROUP BY qid, doc_id)"""

HYBRID = f"""{BM25},
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 30),
dterms AS (SELECT DISTINCT doc_id, unnest(terms) AS term FROM d),
share AS (SELECT qid, doc_id, count(*) / any_value(n) AS score FROM (SELECT qid, term, count(*) OVER (PARTITION BY qid) AS n FROM asked) JOIN dterms USING (term) GROUP BY qid, doc_id),
overlap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM share) WHERE rank <= 30),
mixed AS (SELECT qid, doc_id, o.rank AS dense_rank, round(o.score, 6) AS dense_score, l.rank AS bm25_rank, round(l.score, 6) AS bm25_score,
    round(coalesce(1 / (60 + o.rank), 0) + coalesce(1 / (60 + l.rank), 0), 12) AS rrf FROM overlap o FULL JOIN lexical l USING (qid, doc_id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, doc_id) AS rank FROM mixed)"""

DENSE = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings),
pairs AS (SELECT q.vec_id AS qid, q.label AS qlabel, c.vec_id, c.label, round(list_dot_product(q.e, c.e) / (q.norm * c.norm), 9) AS score FROM v q, v c WHERE q.vec_id % 100 = 0)"""

def _scoped(name: str, condition: str, keys: str) -> str:
    """A fused ranking of its own for each key, of the rows whose company the query names."""
    best = lambda of: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {of} WHERE {condition}) WHERE rank <= 30)"
    return f"""{name}_mixed AS (SELECT qid, doc_id, coalesce(o.source, l.source) AS source, round(coalesce(1 / (60 + o.rank), 0) + coalesce(1 / (60 + l.rank), 0), 12) AS rrf FROM {best("ov")} o FULL JOIN {best("lx")} l USING (qid, doc_id)),
{name}_fused AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rrf DESC, doc_id) AS rank FROM {name}_mixed)"""


ORACLE_SQL = {
    "bm25_topk": f"WITH {BM25} SELECT qid, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 10",
    "bm25_scoped_postfilter": f"""WITH {BM25} SELECT qid, doc_id, source, round(score, 6) AS score, rank
FROM (SELECT scored.*, source, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored JOIN documents USING (doc_id) WHERE source IN ('src0', 'src3', 'src7')) WHERE rank <= 10""",
    "bm25_index_stats": f"WITH {BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM tf, facts GROUP BY term",
    "dense_topk": f"WITH {DENSE} SELECT qid, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10",
    "dense_scoped_prefilter": f"WITH {DENSE} SELECT qid, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM pairs WHERE label = qlabel) WHERE rank <= 10",
    "dense_two_pool_union": f"""WITH {DENSE},
a AS (SELECT qid, vec_id, rank AS first_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 30),
b AS (SELECT qid, vec_id, rank AS second_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM pairs WHERE label % 2 = 0) WHERE rank <= 10)
SELECT qid, vec_id, first_rank, second_rank, row_number() OVER (PARTITION BY qid ORDER BY first_rank NULLS LAST, second_rank) AS pool_order FROM a FULL JOIN b USING (qid, vec_id)""",
    "vector_norm_audit": f"""WITH {DENSE} SELECT count(*) AS vectors, count_if(NOT isfinite(norm)) AS not_finite, count_if(abs(norm - 1) > 1e-3) AS not_unit, round(min(norm), 6) AS norm_min, round(max(norm), 6) AS norm_max FROM v""",
    "rrf_fusion": f"WITH {HYBRID} SELECT qid, doc_id, round(rrf, 9) AS rrf, rank FROM fused WHERE rank <= 30",
    "hybrid_ranks": f"WITH {HYBRID} SELECT qid, doc_id, dense_rank, dense_score, bm25_rank, bm25_score, round(rrf, 9) AS rrf, rank FROM fused",
    "anchored_merge": f"""WITH {HYBRID}, f AS (SELECT fused.*, source FROM fused JOIN documents USING (doc_id)),
a AS (SELECT qid, doc_id, source, rank AS global_rank FROM f WHERE rank <= 10),
b AS (SELECT * FROM (SELECT qid, doc_id, source, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS anchor_rank FROM f WHERE source IN ('src0', 'src1', 'src2')) WHERE anchor_rank <= 3)
SELECT qid, doc_id, source, global_rank, anchor_rank, CASE WHEN global_rank IS NULL THEN 'anchored_company' WHEN anchor_rank IS NULL THEN 'global' ELSE 'global_and_anchored_company' END AS origin,
  row_number() OVER (PARTITION BY qid ORDER BY global_rank NULLS LAST, source, anchor_rank, doc_id) AS position FROM a FULL JOIN b USING (qid, doc_id, source)""",
    "enumeration_select": f"""WITH {HYBRID}, f AS (SELECT fused.*, source, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS k, max(rrf) OVER (PARTITION BY qid) AS best FROM fused JOIN documents USING (doc_id)),
m AS (SELECT *, k = 1 AND rrf >= 0.6 * best AND dense_rank IS NOT NULL AND bm25_rank IS NOT NULL AS representative FROM f)
SELECT qid, doc_id, source, rank, representative, round(rrf, 9) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY representative DESC, rank) AS place FROM m) WHERE place <= 10""",
    "context_merge": f"""WITH {HYBRID}, h AS (SELECT qid // 3 AS request, qid AS sub, doc_id, rrf FROM fused WHERE rank <= 10),
m AS (SELECT request, doc_id, max(rrf) AS best_rrf, count(DISTINCT sub) AS n_subqueries, string_agg(DISTINCT sub, ',' ORDER BY sub) AS subqueries FROM h GROUP BY ALL),
s AS (SELECT *, round(best_rrf + 0.01 * (n_subqueries - 1), 12) AS selection_score FROM m)
SELECT request AS qid, doc_id, round(best_rrf, 9) AS best_rrf, n_subqueries, round(selection_score, 9) AS selection_score, row_number() OVER (PARTITION BY request ORDER BY selection_score DESC, doc_id) AS position, subqueries FROM s""",
    "rerank_stub": f"""WITH {HYBRID},
p AS (SELECT f.qid, f.doc_id, f.rank AS pool_rank, list_filter(list_distinct(string_split_regex(lower(coalesce(b.text, '')), '\\s+')), lambda w: w <> '') AS q, list_filter(string_split_regex(lower(coalesce(d.text, '')), '\\s+'), lambda w: w <> '') AS t
  FROM fused f JOIN documents d ON d.doc_id = f.doc_id JOIN benchmark b ON b.item_id = f.qid WHERE rank <= 30),
s AS (SELECT qid, doc_id, pool_rank, CASE WHEN len(q) = 0 THEN 0 ELSE round(len(list_intersect(q, t)) / len(q), 6) END AS score FROM p)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "scope_aware_retrieval": f"""WITH {HYBRID},
sc AS (SELECT item_id AS qid, replace(lower(coalesce(text, '')), 'ß', 'ss') AS t, coalesce(text, '') AS raw, list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Za-z]{{2,5}}$')), lambda w: upper(w)) AS w FROM benchmark),
nm AS (SELECT qid, t, raw, list_filter([{", ".join(f"CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(a)})([^\\p{{L}}\\p{{N}}_]|$)') THEN '{n}' END" for n, a in SOURCES.items())}], lambda x: x IS NOT NULL) AS companies FROM sc),
asks AS (SELECT qid, companies, CASE WHEN regexp_matches(raw, '(?i){"|".join(ENUMERATION)}') THEN 'enumeration' WHEN ({" OR ".join(f"contains(t, '{c}')" for c in CUES)}) AND len(companies) > 0 THEN 'anchored_global' WHEN {" OR ".join(f"contains(t, '{c}')" for c in CUES)} THEN 'global'
  WHEN len(companies) = 1 THEN 'single_company' WHEN len(companies) > 1 THEN 'explicit_subset' ELSE 'global' END AS scope FROM nm),
rows_ AS (SELECT fused.qid, scope, companies, fused.doc_id, source, dense_rank, bm25_rank, rrf, fused.rank FROM fused JOIN documents USING (doc_id) JOIN asks USING (qid)),
lx AS (SELECT s.qid, d.doc_id, source, scope, score FROM scored s JOIN documents d USING (doc_id) JOIN asks USING (qid) WHERE list_contains(companies, source)),
ov AS (SELECT s.qid, d.doc_id, source, scope, score FROM share s JOIN documents d USING (doc_id) JOIN asks USING (qid) WHERE list_contains(companies, source)),
{_scoped("n", "scope IN ('single_company', 'explicit_subset')", "qid")},
{_scoped("a", "scope = 'anchored_global'", "qid, source")},
enum AS (SELECT *, k = 1 AND rrf >= 0.6 * best AND dense_rank IS NOT NULL AND bm25_rank IS NOT NULL AS representative FROM (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS k, max(rrf) OVER (PARTITION BY qid) AS best FROM rows_ WHERE scope = 'enumeration')),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY representative DESC, rank) AS place FROM enum) WHERE place <= 10),
g AS (SELECT qid, doc_id, source, rank AS global_rank, rrf FROM rows_ WHERE scope = 'anchored_global'),
x AS (SELECT coalesce(g.qid, a.qid) AS qid, coalesce(g.doc_id, a.doc_id) AS doc_id, coalesce(g.source, a.source) AS source, g.global_rank, a.rank AS anchor_rank FROM (SELECT * FROM g WHERE global_rank <= 10) g FULL JOIN (SELECT * FROM a_fused WHERE rank <= 3) a ON g.qid = a.qid AND g.doc_id = a.doc_id AND g.source = a.source),
m AS (SELECT x.*, row_number() OVER (PARTITION BY x.qid ORDER BY x.global_rank NULLS LAST, x.source, x.anchor_rank, x.doc_id) AS position, coalesce(g.rrf, a.rrf) AS rrf FROM x LEFT JOIN g ON g.qid = x.qid AND g.doc_id = x.doc_id LEFT JOIN a_fused a ON a.qid = x.qid AND a.doc_id = x.doc_id)
SELECT qid, scope, doc_id, source, rank::INT AS position, round(rrf, 9) AS rrf, 'global' AS origin FROM rows_ WHERE scope = 'global' AND rank <= 10
UNION ALL SELECT qid, scope, doc_id, source, rank::INT, round(rrf, 9), 'scoped' FROM n_fused JOIN asks USING (qid) WHERE rank <= 10
UNION ALL SELECT qid, scope, doc_id, source, (row_number() OVER (PARTITION BY qid ORDER BY rank))::INT, round(rrf, 9), CASE WHEN representative THEN 'representative' ELSE 'fill' END FROM chosen
UNION ALL SELECT qid, 'anchored_global', doc_id, source, position::INT, round(rrf, 9), CASE WHEN global_rank IS NULL THEN 'anchored_company' WHEN anchor_rank IS NULL THEN 'global' ELSE 'global_and_anchored_company' END FROM m""",
    "scope_detect": r"""WITH c AS (SELECT conv_id, turn, text, replace(lower(coalesce(text, '')), 'ß', 'ss') AS t, list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Za-z]{2,5}$')), lambda w: upper(w)) AS w FROM conversations),
n AS (SELECT *, list_filter([
  CASE WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])(the|of the)([^\p{L}\p{N}_]|$)') OR list_contains(w, 'EN') THEN 'EN' END,
  CASE WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])(que|est)([^\p{L}\p{N}_]|$)') OR list_contains(w, 'FR') THEN 'FR' END,
  CASE WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])(der|die)([^\p{L}\p{N}_]|$)') OR list_contains(w, 'DE') THEN 'DE' END,
  CASE WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])(los|del)([^\p{L}\p{N}_]|$)') OR list_contains(w, 'ES') THEN 'ES' END], lambda x: x IS NOT NULL) AS found,
  contains(t, 'from the') OR contains(t, 'pour les') OR contains(t, 'mit der') AS cue FROM c)
SELECT conv_id, turn, array_to_string(found, ',') AS companies,
  CASE WHEN regexp_matches(coalesce(text, ''), '(?i)\bwho (?:the|of|is)\b|\bthat (?:of|the)\b') THEN 'enumeration' WHEN cue AND len(found) > 0 THEN 'anchored_global' WHEN cue THEN 'global'
    WHEN len(found) = 1 THEN 'single_company' WHEN len(found) > 1 THEN 'explicit_subset' ELSE 'global' END AS scope FROM n""",
}
