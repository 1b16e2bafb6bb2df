"""Scope-aware hybrid retrieval for many queries at once: each scope is a branch of one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import fusion


def ranked(scores: DataFrame, keys: list[str], id_col: str, k: int) -> DataFrame:
    """The k best rows of each key by score (nine places), ties to the smaller id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), id_col)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid(first: DataFrame, second: DataFrame, id_col: str, k: int, rrf_k: int, names: tuple[str, str]) -> DataFrame:
    return fusion.hybrid_ranks(ranked(first, ["qid"], id_col, k), ranked(second, ["qid"], id_col, k), id_col, names, rrf_k)


def scope_aware(
    queries: DataFrame, first: DataFrame, second: DataFrame, chunks: DataFrame, id_col: str, ticker: str,
    top_k: int = 30, candidate_k: int = 30, anchored_k: int = 3, rrf_k: int = 60, names: tuple[str, str] = ("dense", "bm25"),
) -> DataFrame:
    """(qid, scope, id, ticker, position, rrf, origin) by each query's scope.

    `queries` has qid, scope and companies; `first` and `second` hold (qid, id, score) under statistics of the
    whole corpus. single_company and explicit_subset rank only rows of their companies; anchored_global adds the best
    rows of each company to the global list; enumeration picks representatives; global is the global list.
    """
    where = chunks.select(id_col, ticker)
    scopes = queries.select("qid", "scope", "companies")
    everywhere = hybrid(first, second, id_col, candidate_k, rrf_k, names).join(where, id_col).join(scopes.select("qid", "scope"), "qid")
    inside = [x.join(where, id_col).join(scopes, "qid").filter(F.array_contains("companies", F.col(ticker))).select("qid", "scope", ticker, id_col, "score") for x in (first, second)]

    def scoped(kinds: list[str]) -> DataFrame:
        a, b = (x.filter(F.col("scope").isin(kinds)).select("qid", id_col, "score") for x in inside)
        return hybrid(a, b, id_col, candidate_k, rrf_k, names).join(where, id_col).join(scopes.select("qid", "scope"), "qid")

    show = lambda df, position, origin: df.select("qid", "scope", id_col, ticker, F.col(position).cast("int").alias("position"), F.round("rrf", 9).alias("rrf"), origin.alias("origin"))
    plain = show(everywhere.filter("scope = 'global' AND rank <= " + str(top_k)), "rank", F.lit("global"))
    named = show(scoped(["single_company", "explicit_subset"]).filter(F.col("rank") <= top_k), "rank", F.lit("scoped"))
    chosen = fusion.enumeration_select(everywhere.filter("scope = 'enumeration'"), id_col, ticker, top_k, ranks=(f"{names[0]}_rank", f"{names[1]}_rank"))
    chosen = chosen.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    listed = show(chosen, "position", F.when(F.col("representative"), "representative").otherwise("fill"))
    # anchors: a hybrid ranking of its own for each company of the query
    pair = F.concat_ws("|", F.col("qid").cast("string"), F.col(ticker))
    a, b = (x.filter("scope = 'anchored_global'").select(F.col("qid").alias("_q"), F.col(ticker), pair.alias("qid"), id_col, "score") for x in inside)
    owners = a.unionByName(b).select("qid", "_q", ticker).distinct()
    anchors = hybrid(a, b, id_col, candidate_k, rrf_k, names).join(owners, "qid").select(F.col("_q").alias("qid"), id_col, ticker, "rank", "rrf")
    base = everywhere.filter("scope = 'anchored_global'")
    merged = fusion.anchored_merge(base, anchors, id_col, ticker, top_k, anchored_k)
    best = base.select("qid", id_col, F.col("rrf").alias("g")).join(anchors.select("qid", id_col, F.col("rrf").alias("s")), ["qid", id_col], "full_outer").select("qid", id_col, F.coalesce("g", "s").alias("rrf"))
    anchored = show(merged.join(best, ["qid", id_col]).withColumn("scope", F.lit("anchored_global")), "position", F.col("origin"))
    return plain.unionByName(named).unionByName(listed).unionByName(anchored)
