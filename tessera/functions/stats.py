"""Aggregates of reports, by column name: three definitions of the 95th percentile, and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def p95_linear(name: str) -> Column:
    """Linear interpolation between order statistics."""
    return F.percentile(name, F.lit(0.95))


def p95_nearest_rank(name: str) -> Column:
    """The value of rank ceil(0.95 n)."""
    return F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{name}`)")


def p95_ceil_eps(df: DataFrame, name: str, group: list[str] | None = None, alias: str = "p95_ceil_eps") -> DataFrame:
    """The value of rank int(0.95 n + 0.999999), a row a group: the nearest rank unless 0.95 n passes an integer by less than a millionth."""
    keys = group or []
    counted = df.filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy(name)
    wanted = F.greatest(F.lit(1), F.floor(0.95 * F.col("_n") + 0.999999))
    ranked = counted.withColumn("_n", F.sum("_c").over(w)).withColumn("_upto", F.sum("_c").over(upto)).filter(F.col("_upto") >= wanted)
    return ranked.groupBy(*keys).agg(F.min(name).alias(alias))


def distribution(name: str, prefix: str) -> list[Column]:
    """min, median, p95 (nearest rank) and max, named with the prefix."""
    return [F.min(name).alias(f"{prefix}_min"), F.percentile(name, F.lit(0.5)).alias(f"{prefix}_median"), p95_nearest_rank(name).alias(f"{prefix}_p95"), F.max(name).alias(f"{prefix}_max")]
