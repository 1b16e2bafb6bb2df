"""Ranked lists merged: reciprocal rank fusion, anchored, enumerated and multi-query selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def hybrid_ranks(left: DataFrame, right: DataFrame, id_col: str, names: tuple[str, str] = ("dense", "bm25"), rrf_k: int = RRF_K, top_k: int | None = None) -> DataFrame:
    """Both ranks and scores of each item of two ranked lists (qid, id, score, rank), with its fused score and rank."""
    a, b = (x.select("qid", id_col, F.col("rank").alias(f"{n}_rank"), F.round("score", 6).alias(f"{n}_score")) for x, n in zip((left, right), names))
    both = a.join(b, ["qid", id_col], "full_outer")
    part = lambda n: F.coalesce(1 / (rrf_k + F.col(f"{n}_rank")), F.lit(0.0))
    fused = both.withColumn("rrf", F.round(part(names[0]) + part(names[1]), 12))
    out = fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), id_col)))
    return out if top_k is None else out.filter(F.col("rank") <= top_k)


def rrf(lists: list[DataFrame], id_col: str, rrf_k: int = RRF_K, top_k: int | None = None) -> DataFrame:
    """(qid, id, rrf, rank) over any number of ranked lists."""
    every = lists[0].select("qid", id_col, "rank")
    for x in lists[1:]:
        every = every.unionAll(x.select("qid", id_col, "rank"))
    fused = every.groupBy("qid", id_col).agg(F.round(F.sum(1 / (rrf_k + F.col("rank"))), 12).alias("rrf"))
    out = fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), id_col)))
    return out if top_k is None else out.filter(F.col("rank") <= top_k)


def anchored_merge(everywhere: DataFrame, scoped: DataFrame, id_col: str, group: str, top_k: int = 30, each: int = 3) -> DataFrame:
    """The global top_k, then for each group in order its `each` best scoped rows that are new: (qid, id, group, origin, position).

    `everywhere` has qid, id, group, rank; `scoped` the same with ranks within (qid, group).
    """
    first = everywhere.filter(F.col("rank") <= top_k).select("qid", id_col, group, F.col("rank").alias("global_rank"))
    extra = scoped.filter(F.col("rank") <= each).select("qid", id_col, group, F.col("rank").alias("anchor_rank"))
    both = first.join(extra, ["qid", id_col, group], "full_outer")
    origin = F.when(F.col("global_rank").isNull(), "anchored_company").when(F.col("anchor_rank").isNull(), "global").otherwise("global_and_anchored_company")
    order = Window.partitionBy("qid").orderBy(F.col("global_rank").asc_nulls_last(), group, "anchor_rank", id_col)
    return both.withColumn("origin", origin).withColumn("position", F.row_number().over(order))


def enumeration_select(fused: DataFrame, id_col: str, group: str, top_k: int = 10, share: float = 0.6, ranks: tuple[str, str] = ("dense_rank", "bm25_rank")) -> DataFrame:
    """One representative a group if its fused score is at least `share` of the best and both lists rank it; then fill by rank.

    Returns the top_k rows in order of the fused rank with `representative`.
    """
    w = Window.partitionBy("qid")
    best = fused.withColumn("best", F.max("rrf").over(w)).withColumn("of_group", F.row_number().over(Window.partitionBy("qid", group).orderBy("rank")))
    fits = (F.col("of_group") == 1) & (F.col("rrf") >= share * F.col("best")) & F.col(ranks[0]).isNotNull() & F.col(ranks[1]).isNotNull()
    marked = best.withColumn("representative", fits)
    chosen = marked.withColumn("place", F.row_number().over(w.orderBy(F.desc("representative"), "rank"))).filter(F.col("place") <= top_k)
    return chosen.drop("best", "of_group", "place")


def context_merge(hits: DataFrame, id_col: str, bonus: float = 0.01) -> DataFrame:
    """Hits (qid, sub, id, rrf, rank) of several sub-queries merged: best score plus a bonus for each further sub-query that found it."""
    merged = hits.groupBy("qid", id_col).agg(F.max("rrf").alias("best_rrf"), F.count_distinct("sub").alias("n_subqueries"), F.array_sort(F.collect_set("sub")).alias("subqueries"))
    score = F.round(F.col("best_rrf") + bonus * (F.col("n_subqueries") - 1), 12)
    merged = merged.withColumn("selection_score", score)
    return merged.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("selection_score"), id_col)))


def context_coverage(hits: DataFrame, id_col: str, final_k: int = 10, least: int = 2, bonus: float = 0.01) -> DataFrame:
    """Round-robin selection a request: sub-queries take turns until each has `least` chunks, then by selection score.

    A request has a few dozen hits (sub-queries times their list length), so each is one small group.
    """
    scored = hits.join(context_merge(hits, id_col, bonus).select("qid", id_col, "selection_score"), ["qid", id_col])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["sub", "rank", id_col])
        lists = {s: list(x[id_col]) for s, x in order.groupby("sub")}
        owners = pdf.groupby(id_col)["sub"].agg(set).to_dict()
        score = pdf.groupby(id_col)["selection_score"].first().to_dict()
        covered, picked = dict.fromkeys(lists, 0), []
        for _ in range(least):
            for s in sorted(lists):
                if covered[s] >= least or len(picked) >= final_k:
                    continue
                new = next((x for x in lists[s] if x not in {p for p, _ in picked}), None)
                if new is not None:
                    picked.append((new, "coverage"))
                    for o in owners[new]:
                        covered[o] += 1
        taken = {p for p, _ in picked}
        for x in sorted(score, key=lambda x: (-score[x], x)):
            if len(picked) < final_k and x not in taken:
                picked.append((x, "score"))
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], id_col: [p for p, _ in picked], "reason": [r for _, r in picked], "position": range(1, len(picked) + 1)})

    return scored.groupBy("qid").applyInPandas(choose, f"qid long, {id_col} long, reason string, position int")
