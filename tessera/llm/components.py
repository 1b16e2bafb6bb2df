"""Connected components by contraction, on DataFrames alone.

Each round maps every node to the smallest of itself and its neighbours (in id order and, in
every second round, in a random order, which shortens chains), contracts the edges by that
map and drops loops. The maps are composed backwards. Neighbour minima are aggregated with a
partial step, so a node with very many edges costs one row a task; joins on such nodes are
left to the skew join. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every node that has an edge, and the smallest id it can reach. Nulls and loops are no edges."""
    now = stored(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    maps = []
    while not now.isEmpty():
        order = F.xxhash64("v", F.lit(len(maps))) if len(maps) % 2 else F.col("v")
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        best = both.withColumn("o", order).groupBy("u").agg(F.min(F.struct("o", "v")).alias("best"))
        own = F.xxhash64("u", F.lit(len(maps))) if len(maps) % 2 else F.col("u")
        step = best.select("u", F.when(F.struct(own.alias("o"), F.col("u").alias("v")) < F.col("best"), F.col("u")).otherwise(F.col("best.v")).alias("to"))
        step = stored(step, "step")
        maps.append(step)
        left = now.join(step.select(F.col("u").alias("a"), F.col("to").alias("x")), "a")
        both = left.join(step.select(F.col("u").alias("b"), F.col("to").alias("y")), "b")
        now = stored(both.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    whole = maps[-1]
    for step in reversed(maps[:-1]):
        later = whole.select(F.col("u").alias("to"), F.col("to").alias("end"))
        whole = step.join(later, "to", "left").select("u", F.coalesce("end", "to").alias("to"))
    if len(maps) == 1:
        return whole.select(F.col("u").alias("id"), F.col("to").alias("component"))
    whole = stored(whole, "roots")
    least = whole.groupBy("to").agg(F.min("u").alias("component"))
    return whole.join(least, "to").select(F.col("u").alias("id"), "component")
