"""Retrieval metrics over many queries at once, and comparisons of runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

KS = (1, 3, 5, 10, 15, 20, 30)


RUN = r"(?<=\s)(?=(\S+\s+\S+\s+\S+\s+\S+)\s)"
"""Each run of four whole words, white space between them as it is; runs overlap, as the match itself is empty."""


def containing(docs: DataFrame, passages: DataFrame, id_col: str, qid: str = "qid", text: str = "text", passage: str = "passage", most_chars: int = 4_000_000, short_rows: int = 10_000) -> DataFrame:
    """(qid, id) of every document that holds a passage verbatim, each pair once; null texts and passages hold nothing, an empty passage is in every text.

    The passages are counted first. Up to `most_chars` characters go to the workers as one automaton, which reads each text
    once and shuffles nothing; beyond that passages and texts meet by runs of words.
    """
    asked = passages.filter(F.col(passage).isNotNull()).select(qid, passage).distinct()
    held = asked.agg(F.coalesce(F.sum(F.length(passage) + 1), F.lit(0)).alias("n")).first().n <= most_chars
    return (_by_automaton(docs, asked, id_col, qid, text, passage) if held else _by_runs(docs, asked, id_col, qid, text, passage, short_rows)).distinct()


def _by_automaton(docs: DataFrame, asked: DataFrame, id_col: str, qid: str, text: str, passage: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    owners: dict[str, list] = {}
    for q, p in asked.collect():
        owners.setdefault(p, []).append(q)
    sent = asked.sparkSession.sparkContext.broadcast(owners)
    schema = StructType([StructField(qid, asked.schema[qid].dataType), StructField(id_col, docs.schema[id_col].dataType)])
    of_qid = to_arrow_type(asked.schema[qid].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in filter(None, sent.value):
            automaton.add_word(p, p)
        if len(automaton):
            automaton.make_automaton()
        anywhere = sent.value.get("", [])
        for b in batches:
            rows, found = [], []
            for k, t in enumerate(b.column(1)):
                if (t := t.as_py()) is None:
                    continue
                hits = [q for p in ({p for _, p in automaton.iter(t)} if len(automaton) else ()) for q in sent.value[p]] + anywhere
                rows += [k] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([pa.array(found, of_qid), b.column(0).take(pa.array(rows, pa.int64()))], [qid, id_col])

    return docs.select(id_col, text).mapInArrow(run, schema)


def _by_runs(docs: DataFrame, asked: DataFrame, id_col: str, qid: str, text: str, passage: str, short_rows: int) -> DataFrame:
    """Four words in a row inside a passage, with white space around them, stand as they are in any text that holds it.

    So passages meet texts by equal runs, each passage by that of its runs which the fewest texts have, and are then
    compared as they are. Passages without such a run (of few words) are sent to the texts, at most `short_rows` of them.
    """
    runs = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(RUN), F.lit(1)))).alias("_run")
    keys = asked.select(qid, passage, runs(F.col(passage)))
    shared = docs.select(id_col, runs(F.col(text))).join(keys.select("_run").distinct(), "_run")  # the passages' runs are few next to the texts'
    counted = shared.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    rarest = keys.join(counted, "_run").groupBy(qid, passage).agg(F.min_by("_run", F.struct("_n", "_run")).alias("_run"))
    met = shared.join(rarest, "_run").select(qid, passage, id_col)
    found = met.join(docs.select(id_col, text), id_col).filter(F.contains(text, passage)).select(qid, id_col)
    short = asked.filter(~F.col(passage).rlike(RUN)).limit(short_rows + 1).collect()
    if len(short) > short_rows:
        raise ValueError(f"more than {short_rows} passages without four words in a row")
    if short:
        held = F.array(*[F.struct(F.lit(r[0]).alias("q"), F.lit(r[1]).alias("p")) for r in short])
        hits = docs.select(id_col, F.explode(F.filter(held, lambda x: F.contains(F.col(text), x["p"]))).alias("x"))
        found = found.unionByName(hits.select(F.col("x.q").alias(qid), id_col))
    return found


def ranks_of_gold(gold: DataFrame, results: DataFrame, id_col: str) -> DataFrame:
    """(qid, id, rank): each gold item with its rank, null if it was not retrieved."""
    return gold.select("qid", id_col).join(results.select("qid", id_col, "rank"), ["qid", id_col], "left")


def per_query(gold: DataFrame, results: DataFrame, id_col: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """Recall, hit, complete and reciprocal rank at each k, one row a query with gold."""
    ranked = ranks_of_gold(gold, results, id_col)
    aggregates: list[Column] = [F.count(F.lit(1)).alias("n_gold")]
    for k in ks:
        within = F.count_if(F.col("rank") <= k)
        first = F.min(F.when(F.col("rank") <= k, F.col("rank")))
        aggregates += [
            F.round(within / F.count(F.lit(1)), 6).alias(f"recall_at_{k}"),
            (within > 0).cast("int").alias(f"hit_at_{k}"),
            (within == F.count(F.lit(1))).cast("int").alias(f"complete_at_{k}"),
            F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias(f"mrr_at_{k}"),
        ]
    return ranked.groupBy("qid").agg(*aggregates)


def names(ks: tuple[int, ...] = KS) -> list[str]:
    return [f"{m}_at_{k}" for k in ks for m in ("recall", "hit", "complete", "mrr")]


def grouped(per: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Means of the metric columns over grouping sets (one scan); grouping columns are null where they are not grouped by."""
    keys = list(dict.fromkeys(c for s in sets for c in s))
    return per.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(
        F.grouping_id().alias("grouping"), F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in columns]
    )


def missing_gold(gold: DataFrame, corpus: DataFrame, id_col: str) -> DataFrame:
    """Gold items that the corpus does not hold; must be empty before a run."""
    return gold.join(corpus.select(id_col), id_col, "left_anti")


def compare(gold: DataFrame, a: DataFrame, b: DataFrame, id_col: str, k: int = 10) -> DataFrame:
    """Gold items a query split into found by both runs, by A only, by B only, by neither; and the union's recall."""
    hit = lambda x, name: x.filter(F.col("rank") <= k).select("qid", id_col, F.lit(True).alias(name))
    marked = gold.select("qid", id_col).join(hit(a, "in_a"), ["qid", id_col], "left").join(hit(b, "in_b"), ["qid", id_col], "left").fillna(False, ["in_a", "in_b"])
    return marked.groupBy("qid").agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("both"),
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("a_only"),
        F.count_if(~F.col("in_a") & F.col("in_b")).alias("b_only"),
        F.count_if(~F.col("in_a") & ~F.col("in_b")).alias("neither"),
        F.round(F.avg((F.col("in_a") | F.col("in_b")).cast("int")), 6).alias("union_recall"),
    )


def sweep(gold: DataFrame, results: DataFrame, id_col: str, ks: tuple[int, ...]) -> DataFrame:
    """For each candidate count: mean recall and the gold items missed."""
    ranked = ranks_of_gold(gold, results, id_col)
    each = ranked.select("qid", "rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("candidate_k"))
    found = (F.coalesce(F.col("rank") <= F.col("candidate_k"), F.lit(False))).cast("int")
    per = each.groupBy("candidate_k", "qid").agg(F.avg(found).alias("recall"), F.sum(1 - found).alias("missed"))
    return per.groupBy("candidate_k").agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.sum("missed").alias("missed_gold"))


def within_group_ranks(scores: DataFrame, gold: DataFrame, groups: DataFrame, id_col: str, group: str) -> DataFrame:
    """(qid, id, group, group_rank): where each gold item stands among the scored rows of its own group."""
    owned = gold.select("qid", id_col).join(groups.select(id_col, group), id_col)
    rows = scores.join(groups.select(id_col, group), id_col).join(owned.select("qid", group).distinct(), ["qid", group], "left_semi")
    order = Window.partitionBy("qid", group).orderBy(F.desc(F.round("score", 9)), id_col)
    ranked = rows.withColumn("group_rank", F.row_number().over(order)).select("qid", id_col, "group_rank")
    return owned.join(ranked, ["qid", id_col], "left")
