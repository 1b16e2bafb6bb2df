"""BM25 (Lucene variant) over many queries at once, on a stored index.

idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a term adds idf * tf / (tf + k1 * (1 - b + b * dl / avgdl)).
Only documents with a score above 0 are ranked. Ties go to the smaller document id.

The index is built once: every text is tokenised once, its postings (term, doc_id, tf, dl, df) are
sorted by term and document over range partitions, so a term of any frequency is spread over tasks and
files, and corpus facts are two numbers. Queries carry no hint: their terms are broadcast by Spark
while they are under its threshold, and (query, document) sums are the only rows shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import search_terms
from tessera.sources.store import stored

K1, B = 1.5, 0.75


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    n_docs: int
    avgdl: float


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", require_text: bool = False) -> Index:
    """The stored index of (id, text). With `require_text` a null or blank text is an error."""
    rows = docs.select(F.col(id_col).alias("doc_id"), search_terms(F.col(text_col)).alias("terms"), (F.coalesce(F.trim(text_col), F.lit("")) == "").alias("blank"))
    terms = stored(rows.withColumn("dl", F.size("terms")), "terms")
    facts = terms.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.count_if("blank").alias("blank")).first()
    if require_text and facts.blank:
        raise ValueError(f"{facts.blank} texts to index are empty")
    tf = terms.select("doc_id", "dl", F.explode("terms").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    postings = tf.join(df, "term").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    return Index(stored(postings.select("term", "doc_id", "tf", "dl", "df"), "postings"), facts.n, facts.avgdl or 0.0)


def idf(n: int, df: Column) -> Column:
    return F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))


def term_stats(index: Index) -> DataFrame:
    """(term, df, cf, idf)."""
    stats = index.postings.groupBy("term").agg(F.first("df").alias("df"), F.sum("tf").alias("cf"))
    return stats.select("term", "df", "cf", idf(index.n_docs, F.col("df")).alias("idf"))


def query_terms(queries: DataFrame, qid: str, query_text: str) -> DataFrame:
    """(qid, n, term): each distinct term of a query once, with their number."""
    asked = queries.select(F.col(qid).alias("qid"), F.array_distinct(search_terms(F.col(query_text))).alias("terms"))
    return asked.select("qid", F.size("terms").alias("n"), F.explode("terms").alias("term"))


def scores(queries: DataFrame, index: Index, qid: str = "item_id", query_text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc_id, score, share) of every document that has a query term: BM25, and the share of the query's terms it has."""
    weight = idf(index.n_docs, F.col("df")) * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.avgdl)))
    met = index.postings.join(query_terms(queries, qid, query_text), "term")
    return met.groupBy("qid", "doc_id").agg(F.sum(weight).alias("score"), (F.count(F.lit(1)) / F.max("n")).alias("share"))


def top(scored: DataFrame, k: int, id_col: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best a query with their rank; scores are compared at nine places, ties go to the smaller id."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round(score, 9)), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
