"""Evaluation queries: gold is every document that contains a benchmark passage verbatim."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.stats import p95_ceil_eps, p95_linear, p95_nearest_rank
from tessera.functions.text import token_overlap, tokens
from tessera.operators import bm25, metrics
from tessera.plans import retrieval as R
from tessera.sources.tables import table


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, doc_id): all documents that hold a passage, met by the passage's rarest run of words."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    return metrics.containing(table(spark, sf, "documents").select("doc_id", "text"), items, "doc_id")


def _run(spark: SparkSession, sf: str, k: int = 30) -> DataFrame:
    return bm25.top(R.scores(spark, sf), k)


def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.per_query(gold(spark, sf), _run(spark, sf), "doc_id")


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """Per-query metrics with a question type (parity of the item) and a company (item in fives)."""
    per = metrics.per_query(gold(spark, sf), _run(spark, sf), "doc_id", (1, 10, 30))
    kind = F.when(F.col("qid") % 2 == 0, "single_narrative").otherwise("single_table")
    return per.withColumn("question_type", kind).withColumn("company", (F.col("qid") % 5).cast("string"))


def metrics_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.grouped(_typed(spark, sf), [[], ["question_type"], ["company"]], metrics.names((1, 10, 30))).drop("grouping")


def expected_type_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Recall by the language of the expected document: a query counts in each language its gold has."""
    g = gold(spark, sf)
    kinds = g.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("qid").agg(F.array_sort(F.collect_set("lang")).alias("kinds"))
    per = metrics.per_query(g, _run(spark, sf), "doc_id", (10,))
    each = per.join(kinds, "qid").select("recall_at_10", F.explode("kinds").alias("expected_type"))
    return each.groupBy("expected_type").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall_at_10"), 6).alias("recall_at_10"))


def gold_missing_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents that are no gold of any passage: the anti-join that must be empty for a sound gold set."""
    return metrics.missing_gold(table(spark, sf, "labels").select("doc_id").distinct(), gold(spark, sf).select("doc_id").distinct(), "doc_id")


def run_compare(spark: SparkSession, sf: str) -> DataFrame:
    a = R.term_overlap_ranks(spark, sf, 30)
    return metrics.compare(gold(spark, sf), a, _run(spark, sf), "doc_id", 10)


def oracle_union_recall(spark: SparkSession, sf: str) -> DataFrame:
    each = metrics.compare(gold(spark, sf), R.term_overlap_ranks(spark, sf, 30), _run(spark, sf), "doc_id", 30)
    return each.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("union_recall"), 6).alias("union_recall"), F.sum("neither").alias("missed"))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_type", "value")
    main = events.groupBy("event_type").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"),
        F.round(p95_linear("value"), 6).alias("p95_linear"), F.round(p95_nearest_rank("value"), 6).alias("p95_nearest_rank"),
    )
    return main.join(p95_ceil_eps(events, "value", ["event_type"]), "event_type").withColumn("p95_ceil_eps", F.round("p95_ceil_eps", 6))


def candidate_k_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.sweep(gold(spark, sf), _run(spark, sf, 200), "doc_id", (1, 5, 10, 30, 50, 100, 200))


def token_overlap_match(spark: SparkSession, sf: str) -> DataFrame:
    """For each passage the hybrid candidate whose tokens cover it best, if at least 0.60 (ties: smaller id); 'exact' where it is contained."""
    pool = R.hybrid(spark, sf).filter("rank <= 30").select("qid", "doc_id")
    pairs = pool.join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("body")), "doc_id").join(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage")), "qid")
    low = lambda c: tokens(F.lower(F.col(c)))
    scored = pairs.select("qid", "doc_id", F.round(token_overlap(low("passage"), low("body")), 6).alias("overlap"), F.contains("body", "passage").alias("contained"))
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("contained"), F.desc("overlap"), "doc_id"))).filter("k = 1")
    return best.filter("contained OR overlap >= 0.6").select("qid", "doc_id", "overlap", F.when(F.col("contained"), "exact").otherwise("token_overlap").alias("method"))


def review_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Required (all documents) minus reviewed (labelled), by source."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    done = table(spark, sf, "labels").select("doc_id").distinct().withColumn("done", F.lit(1))
    each = docs.join(done, "doc_id", "left").groupBy("source")
    return each.agg(F.count(F.lit(1)).alias("required"), F.count("done").alias("reviewed"), (F.count(F.lit(1)) - F.count("done")).alias("missing"), F.round(F.count("done") / F.count(F.lit(1)), 6).alias("coverage"))


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_metrics, metrics_grouping_sets, expected_type_explode, gold_missing_anti, run_compare, oracle_union_recall, latency_percentiles,
        candidate_k_sweep, token_overlap_match, review_coverage,
    )
}

GOLD = "gold AS (SELECT item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
RUN = "ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)"


def _at(k: int) -> str:
    return (
        f"round(count(*) FILTER (rank <= {k}) / count(*), 6) AS recall_at_{k}, (count(*) FILTER (rank <= {k}) > 0)::INT AS hit_at_{k}, "
        f"(count(*) FILTER (rank <= {k}) = count(*))::INT AS complete_at_{k}, round(coalesce(1 / min(rank) FILTER (rank <= {k}), 0), 6) AS mrr_at_{k}"
    )


def _per(ks: tuple[int, ...]) -> str:
    return f"WITH {R.BM25}, {RUN}, {GOLD}, per AS (SELECT qid, count(*) AS n_gold, {', '.join(map(_at, ks))} FROM gold LEFT JOIN (SELECT * FROM ranked WHERE rank <= 30) USING (qid, doc_id) GROUP BY qid)"


_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in metrics.names((1, 10, 30)))
_COMPARE = f"""WITH {R.HYBRID}, {GOLD},
m AS (SELECT qid, doc_id, coalesce(o.rank <= %d, false) AS a, coalesce(l.rank <= %d, false) AS b FROM gold LEFT JOIN overlap o USING (qid, doc_id) LEFT JOIN lexical l USING (qid, doc_id)),
c AS (SELECT qid, count_if(a AND b) AS both_n, count_if(a AND NOT b) AS a_only, count_if(NOT a AND b) AS b_only, count_if(NOT a AND NOT b) AS neither, round(avg((a OR b)::INT), 6) AS union_recall FROM m GROUP BY qid)"""

ORACLE_SQL = {
    "retrieval_metrics": _per(metrics.KS) + " SELECT * FROM per",
    "metrics_grouping_sets": _per((1, 10, 30))
    + f""", t AS (SELECT *, CASE WHEN qid % 2 = 0 THEN 'single_narrative' ELSE 'single_table' END AS question_type, (qid % 5)::VARCHAR AS company FROM per)
SELECT question_type, company, count(*) AS n_queries, {_MEANS} FROM t GROUP BY GROUPING SETS ((), (question_type), (company))""",
    "expected_type_explode": _per((10,))
    + " SELECT lang AS expected_type, count(*) AS n_queries, round(avg(recall_at_10), 6) AS recall_at_10 FROM per JOIN (SELECT DISTINCT qid, lang FROM gold JOIN documents USING (doc_id)) USING (qid) GROUP BY lang",
    "gold_missing_anti": f"WITH {GOLD} SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM gold)",
    "run_compare": _COMPARE % (10, 10) + ' SELECT qid, both_n AS "both", a_only, b_only, neither, union_recall FROM c',
    "oracle_union_recall": _COMPARE % (30, 30) + " SELECT count(*) AS n_queries, round(avg(union_recall), 6) AS union_recall, sum(neither)::BIGINT AS missed FROM c",
    "latency_percentiles": """
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95_linear,
  round(quantile_disc(value, 0.95), 6) AS p95_nearest_rank, round(list_sort(list(value))[floor(0.95 * count(value) + 0.999999)::INT], 6) AS p95_ceil_eps FROM events GROUP BY event_type""",
    "candidate_k_sweep": f"""WITH {R.BM25}, {RUN}, {GOLD}, k AS (SELECT unnest([1, 5, 10, 30, 50, 100, 200]) AS candidate_k),
g AS (SELECT candidate_k, qid, avg(coalesce(rank <= least(candidate_k, 200), false)::INT) AS recall, sum(1 - coalesce(rank <= candidate_k, false)::INT) AS missed FROM gold LEFT JOIN ranked USING (qid, doc_id), k GROUP BY ALL)
SELECT candidate_k, round(avg(recall), 6) AS mean_recall, sum(missed)::BIGINT AS missed_gold FROM g GROUP BY candidate_k""",
    "token_overlap_match": f"""WITH {R.HYBRID},
p AS (SELECT qid, f.doc_id, contains(x.text, b.text) AS contained, list_distinct(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]')) AS want, regexp_extract_all(lower(x.text), '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]') AS got
  FROM fused f JOIN documents x ON x.doc_id = f.doc_id JOIN benchmark b ON b.item_id = f.qid WHERE rank <= 30),
s AS (SELECT qid, doc_id, contained, round(len(list_intersect(want, got)) / len(want), 6) AS overlap FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY contained DESC, overlap DESC, doc_id) AS k FROM s)
SELECT qid, doc_id, overlap, CASE WHEN contained THEN 'exact' ELSE 'token_overlap' END AS method FROM k WHERE k = 1 AND (contained OR overlap >= 0.6)""",
    "review_coverage": """SELECT source, count(*) AS required, count(l.doc_id) AS reviewed, count(*) - count(l.doc_id) AS missing, round(count(l.doc_id) / count(*), 6) AS coverage
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""",
}
