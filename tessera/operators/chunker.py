"""Blocks to chunks: narrative runs are cut by tokens, logical tables are composed and stay whole, every chunk knows its blocks.

Runs come from windows over the block order; a run is one section's text, so it is cut in one
row. Provenance (which blocks a span overlaps, with headings always) is an array expression.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import TOKEN, tokens
from tessera.operators.compose import compose_tables
from tessera.operators.logical import violations
from tessera.operators.chunking import SEPARATORS, islands, recursive_windows

NARRATIVE, TABLE, EXCLUDED = ["heading", "paragraph", "list_item"], ["data_table", "text_table", "unknown_table"], ["navigation"]


def validate_config(config: dict) -> dict:
    """The config, if its sizes, strategy and schema versions fit."""
    problems = [
        name
        for name, ok in {
            "schema_version": config.get("schema_version") == 3, "table_schema_version": config.get("table_schema_version") == 2, "length_function": config.get("length_function") == "tokens",
            "strategy": config.get("strategy") in ("recursive", "fixed"), "chunk_overlap": 0 <= config.get("chunk_overlap", -1) < config.get("chunk_size", 0),
        }.items()
        if not ok
    ]
    if problems:
        raise ValueError(f"chunking config: {', '.join(problems)}")
    return config


def config_violations(settings: DataFrame, key: str) -> DataFrame:
    """(key, rule) of a table of settings: the rules of `validate_config` as expressions."""
    rules = {
        "schema_version": F.col("schema_version") == 3, "table_schema_version": F.col("table_schema_version") == 2, "length_function": F.col("length_function") == "tokens",
        "strategy": F.col("strategy").isin("recursive", "fixed"), "chunk_overlap": (F.col("chunk_overlap") >= 0) & (F.col("chunk_overlap") < F.col("chunk_size")),
    }
    return violations(settings, key, rules)


def config_sha256(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def fixed_windows(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Character spans of windows of `size` tokens that share `overlap` tokens."""
    import regex

    found = [m.span() for m in regex.finditer(TOKEN, text)]
    step = size - min(overlap, size - 1)
    starts = range(0, max(1, len(found) - size + step), step) if found else []
    return [(found[a][0], found[min(a + size, len(found)) - 1][1]) for a in starts]


def chunk_blocks(blocks: DataFrame, config: dict, doc: str = "doc") -> DataFrame:
    """chunk_id, chunk_index, content_type, source_group, section, text, block_ids, source_text_start and _end, config hash.

    `blocks` has doc, block_id, block_index, content_type, text, section, effective_section_path (array) and, for tables, logical_table_id.
    """
    validate_config(config)
    size, overlap = config["chunk_size"], config["chunk_overlap"]
    kind = F.when(F.col("content_type").isin(NARRATIVE), "narrative").when(F.col("content_type").isin(TABLE), "table").otherwise("excluded")
    key = F.when(kind == "table", F.col("logical_table_id")).otherwise(F.array_join("effective_section_path", "\n"))
    runs = islands(blocks.withColumn("kind", kind), doc, "block_index", [kind, key], kind == "excluded")
    entry = F.struct("block_index", "block_id", "content_type", "text", "section", F.array_join("effective_section_path", "\n").alias("prefix"), F.col("logical_table_id").alias("table"))
    groups = runs.groupBy(doc, "island", "kind").agg(F.array_sort(F.collect_list(entry)).alias("blocks"))
    cut = recursive_windows if config["strategy"] == "recursive" else fixed_windows
    separators = config.get("separators", SEPARATORS)
    columns = ["doc", "island", "span", "content_type", "section", "text", "block_ids", "source_text_start", "source_text_end", "logical_table_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        for f in frames:
            out = []
            for d, island, kind_, items in zip(f["doc"], f["island"], f["kind"], f["blocks"]):
                prefix, section = items[0]["prefix"], items[0]["section"]
                if kind_ == "table":
                    out.append((d, island, 0, "table", section, prefix, [b["block_id"] for b in items], None, None, items[0]["table"]))
                    continue
                body, places = "", []
                for b in items:
                    line = ("- " if b["content_type"] == "list_item" else "") + (b["text"] or "")
                    body += "\n\n" if places else ""
                    places.append((len(body), len(body) + len(line), b))
                    body += line
                room = max(1, size - len(regex.findall(TOKEN, prefix)))
                extra = (separators,) if cut is recursive_windows else ()
                for k, (a, z) in enumerate(cut(body, room, min(overlap, room - 1), *extra)):
                    ids = [b["block_id"] for s, e, b in places if (e > a and s < z) or b["content_type"] == "heading"]
                    out.append((d, island, k, "narrative", section, f"{prefix}\n\n{body[a:z]}", ids, a, z, None))
            yield pd.DataFrame(out, columns=columns)

    schema = "doc bigint, island int, span int, content_type string, section string, text string, block_ids array<string>, source_text_start int, source_text_end int, logical_table_id string"
    found = groups.select(F.col(doc).cast("long").alias("doc"), "island", "kind", "blocks").mapInPandas(run, schema)
    # a table's text below its section's lines: composed of its fragments, or the block's own text where it has no grid
    plain = blocks.filter(F.col("logical_table_id").isNull()).select(F.element_at(F.array("block_id"), 1).alias("_block"), F.col("text").alias("_text"))
    texts = compose_tables(blocks, doc).select("doc", "logical_table_id", "mode", "title", F.col("text").alias("_text"))
    found = found.join(texts, ["doc", "logical_table_id"], "left")
    found = found.join(plain.withColumnRenamed("_text", "_own"), (F.col("content_type") == "table") & F.col("logical_table_id").isNull() & (F.get("block_ids", 0) == F.col("_block")), "left").drop("_block")
    found = found.withColumn("text", F.when(F.col("content_type") == "table", F.concat_ws("\n\n", "text", F.coalesce("_text", "_own"))).otherwise(F.col("text"))).withColumnRenamed("mode", "composition_mode").drop("_text", "_own")
    index = F.row_number().over(Window.partitionBy("doc").orderBy("island", "span"))
    numbered = found.withColumn("chunk_index", index).withColumn("chunk_id", F.format_string("%s-CHUNK-%06d", F.col("doc").cast("string"), "chunk_index"))
    return numbered.withColumn("n_tokens", F.size(tokens(F.col("text")))).withColumn("chunking_config_sha256", F.lit(config_sha256(config))).drop("span").withColumnRenamed("island", "source_group").withColumnRenamed("doc", doc)
