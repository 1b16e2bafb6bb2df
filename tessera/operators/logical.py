"""Set-based operators over logical tables held as rows and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import canonical


def pipe_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line, cells): lines with a pipe; outer pipes are no cells."""
    lines = docs.select(doc, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "raw")).filter(F.contains("raw", F.lit("|")))
    bare = F.regexp_replace(F.trim("raw"), r"^\||\|$", "")
    return lines.select(doc, "line", F.transform(F.split(bare, r"\|", -1), lambda c: F.trim(c)).alias("cells"))


def table_runs(rows: DataFrame, doc: str) -> DataFrame:
    """Adds `run`: pipe lines that follow each other are one table."""
    w = Window.partitionBy(doc).orderBy("line")
    return rows.withColumn("run", F.sum(F.when(F.col("line") == F.lag("line").over(w) + 1, 0).otherwise(1)).over(w).cast("int"))


def grid_density(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, width, whether all rows are equally wide, and the share of empty cells of the padded grid."""
    full = F.size(F.filter("cells", lambda c: c != ""))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("cells")).alias("width"), (F.min(F.size("cells")) == F.max(F.size("cells"))).alias("uniform"), F.sum(full).alias("filled"))
    return out.withColumn("empty_density", F.round(1 - F.col("filled") / (F.col("n_rows") * F.col("width")), 6))


def linked(fragments: DataFrame, doc: str, order: str, compatible: list[str]) -> DataFrame:
    """Adds `logical_table`: a fragment continues the one before it if the compatible columns are equal."""
    w = Window.partitionBy(doc).orderBy(order)
    same = F.lag(F.struct(*compatible)).over(w).eqNullSafe(F.struct(*compatible))
    return fragments.withColumn("continues", F.coalesce(same, F.lit(False))).withColumn("logical_table", F.sum((~F.col("continues")).cast("int")).over(w).cast("int"))


def compose_horizontal(left: DataFrame, right: DataFrame, label: str) -> DataFrame:
    """Two fragments side by side: a full outer merge on the normalized row label, the left label shown first."""
    a = left.withColumn("_k", canonical(F.col(label))).withColumnRenamed(label, "_a")
    b = right.withColumn("_k", canonical(F.col(label))).withColumnRenamed(label, "_b")
    return a.join(b, "_k", "full_outer").withColumn(label, F.coalesce("_a", "_b")).drop("_k", "_a", "_b")


def compose_vertical(parts: list[DataFrame]) -> DataFrame:
    """Fragments with equal columns, one below the other, with the fragment's number."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("fragment", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def row_sentences(label: Column, headers: list[str], values: list[Column], context: str = "") -> Column:
    """One sentence for each value that is not empty: `label for context — header was value.`"""
    lead = F.concat(label, F.lit(f" for {context}")) if context else label
    each = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(lead, F.lit(f" — {h} was "), v.cast("string"), F.lit("."))) for h, v in zip(headers, values)]
    return F.array_join(F.array_compact(F.array(*each)), " ")


def regression(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status) of two versions: added, removed, changed or equal."""
    both = old.select(key, F.col(value).alias("_o"), F.lit(1).alias("_in_o")).join(new.select(key, F.col(value).alias("_n"), F.lit(1).alias("_in_n")), key, "full_outer")
    status = F.when(F.col("_in_o").isNull(), "added").when(F.col("_in_n").isNull(), "removed").when(F.col("_o").eqNullSafe(F.col("_n")), "equal").otherwise("changed")
    return both.select(key, status.alias("status"))


def upsert(base: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Rows of base whose key is not updated, and the updates."""
    return base.join(updates.select(*key).distinct(), key, "left_anti").unionByName(updates)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))
