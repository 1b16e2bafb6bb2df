"""Labels of an older corpus matched to the chunks of a newer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import canonical, token_overlap, tokens
from tessera.operators.logical import violations


def match_evidence(evidence: DataFrame, chunks: DataFrame, least: float = 0.60) -> DataFrame:
    """The chunk each piece of evidence is now in: (evidence_id, chunk_id, method, overlap); without one the method is `unresolved`.

    `evidence` has evidence_id, block_ids (array), content_type, text and logical_table_id (null for narrative);
    `chunks` has chunk_id, block_ids, content_type, text and logical_table_id. Candidates share a block and the type.
    Exact containment goes before the same table, that before the best token overlap of at least `least`; ties go to
    the smaller chunk id.
    """
    asked = evidence.select("evidence_id", "content_type", F.col("text").alias("_t"), F.col("logical_table_id").alias("_table"), F.explode_outer("block_ids").alias("_block"))
    held = chunks.select("chunk_id", "content_type", F.col("text").alias("_c"), "logical_table_id", F.explode("block_ids").alias("_block"))
    pairs = asked.join(held, ["_block", "content_type"]).dropDuplicates(["evidence_id", "chunk_id"])
    low = lambda c: tokens(canonical(F.coalesce(F.col(c), F.lit(""))))
    scored = pairs.withColumn("overlap", F.round(token_overlap(low("_t"), low("_c")), 6)).withColumn(
        "step",
        F.when(F.contains(canonical(F.coalesce("_c", F.lit(""))), canonical(F.coalesce("_t", F.lit("")))), 0).when(F.col("_table") == F.col("logical_table_id"), 1).when(F.col("overlap") >= least, 2),
    )
    order = Window.partitionBy("evidence_id").orderBy("step", F.desc("overlap"), "chunk_id")
    best = scored.filter("step IS NOT NULL").withColumn("_k", F.row_number().over(order)).filter("_k = 1")
    method = F.element_at(F.array(F.lit("exact"), F.lit("table_identity"), F.lit("token_overlap")), F.col("step") + 1)
    found = best.select("evidence_id", "chunk_id", method.alias("method"), "overlap")
    return evidence.select("evidence_id").join(found, "evidence_id", "left").withColumn("method", F.coalesce("method", F.lit("unresolved")))


def gold_violations(gold: DataFrame, chunks: DataFrame, records: int | None = None) -> DataFrame:
    """(record_id, rule): each record is approved and names chunks that exist, each once; a null id stands for the whole set.

    `gold` has record_id, status and relevant (array of chunk ids). The set must have `records` records, if a number is
    given, and its chunks hold tables and come from one config.
    """
    rows = gold.select("record_id", "status", F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"))
    found = violations(rows, "record_id", {"not_approved": F.col("status") == "approved", "no_gold": F.size("relevant") > 0, "repeated_gold": F.size("relevant") == F.size(F.array_distinct("relevant"))})
    named = rows.select("record_id", F.explode(F.array_distinct("relevant")).alias("chunk_id"))
    unknown = named.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("record_id", F.lit("unknown_chunk").alias("rule")).distinct()
    whole = F.lit(None).cast(gold.schema["record_id"].dataType).alias("record_id")
    configs = F.col("chunking_config_sha256")
    of_chunks = chunks.agg(F.count_if(F.col("content_type") == "table").alias("tables"), (F.min(configs).eqNullSafe(F.max(configs)) & (F.count(configs) == F.count(F.lit(1)))).alias("one"))
    found = found.unionByName(unknown).unionByName(violations(of_chunks.withColumn("record_id", whole), "record_id", {"no_tables": F.col("tables") > 0, "mixed_config": F.col("one")}))
    if records is not None:
        found = found.unionByName(violations(gold.agg(F.count(F.lit(1)).alias("n")).withColumn("record_id", whole), "record_id", {"record_count": F.col("n") == records}))
    return found
