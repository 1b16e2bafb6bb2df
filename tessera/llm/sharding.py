"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys (document ids) and `replicas` virtual nodes a shard sit on a ring of 64-bit positions. A
key belongs to the next node clockwise; a shard that is full passes its surplus on, clockwise,
until a shard has room. Capacities add up to the number of rows and differ by at most one, so
the law `rows` holds exactly: shard sizes are at most one row apart.

Ring cells (the ring cut into 2**cell_bits equal cells and at the nodes) are counted by one
aggregation; the driver sees only these counts, whose number is fixed, and plans which rank
interval of each arc goes to which shard. Ranks within a cell come from a window over a few
rows, ordered by position, id, size and checksum, so the order of the input decides nothing:
rows it leaves open agree in all four. Cells that one repeated id makes hot are cut by a hash of
the same columns first, and of these rows that repeat very often by row number.

A null id is one more key. Repeated rows keep one slot each. An empty table gives no rows.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import stored

HOT_CELLS, HOT_ROWS = 1000, 20_000
"""A cell with more than HOT_ROWS and 1/HOT_CELLS of all rows is hot."""


def ring(shards: int, replicas: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order; positions are signed 64-bit."""
    place = lambda s, r: xxhash.xxh3_64_intdigest(f"{s}/{r}".encode()) - (1 << 63)
    return sorted((place(s, r), s) for s in range(shards) for r in range(replicas))


def plan(arcs: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): fill shards clockwise from each arc under equal capacities."""
    total = sum(arcs)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    done = [0] * len(arcs)
    out = []
    open_arcs = [a for a, n in enumerate(arcs) if n]
    for step in range(len(arcs)):
        still = []
        for a in open_arcs:
            s = owners[(a + step) % len(arcs)]
            take = min(arcs[a] - done[a], room[s] - used[s])
            if take:
                out.append((a, done[a], done[a] + take, s, used[s]))
                used[s] += take
                done[a] += take
            if done[a] < arcs[a]:
                still.append(a)
        open_arcs = still
        if not open_arcs:
            break
    return out


def _equal(names: list[str], row: Row) -> Column:
    out = F.lit(True)
    for name, value in zip(names, row):
        out &= F.col(name).eqNullSafe(F.lit(value))
    return out


def assign(keys: DataFrame, shards: int, replicas: int = 128, cell_bits: int = 14) -> DataFrame:
    """Adds `shard` and `slot` to rows that have a `pos` (long, ring position), doc_id, size, text_crc32, and a unique `rid` (long)."""
    spark = keys.sparkSession
    nodes = ring(shards, replicas)
    positions = [p for p, _ in nodes]
    shift = 64 - cell_bits
    cuts: dict[int, list[int]] = {}
    for p in positions:
        cuts.setdefault(p >> shift, []).append(p)
    first = {c: bisect.bisect_left(positions, c << shift) for c in range(-(1 << cell_bits - 1), 1 << cell_bits - 1)}
    cells = spark.createDataFrame(pa.table({
        "cell": pa.array(list(first), pa.int64()),
        "before": pa.array(list(first.values()), pa.int32()),
        "cuts": pa.array([cuts.get(c, []) for c in first], pa.list_(pa.int64())),
    }))
    arc = (F.col("before") + F.size(F.filter("cuts", lambda c: c < F.col("pos")))) % len(nodes)
    placed = keys.withColumn("cell", F.shiftright("pos", shift)).join(F.broadcast(cells), "cell").withColumn("arc", arc).drop("before", "cuts")
    counts = placed.groupBy("arc", "cell").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2**cell_bits + nodes rows
    total = sum(r.n for r in counts)
    most = max(HOT_ROWS, total // HOT_CELLS)
    hot = [(r.arc, r.cell) for r in counts if r.n > most]
    same = ["pos", "doc_id", "size", "text_crc32"]  # rows that agree in these are one to the ring
    if hot:
        inside = F.struct("arc", "cell").isin([F.struct(F.lit(a).cast("int"), F.lit(c).cast("long")) for a, c in hot])
        often = placed.filter(inside).groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).drop("n").collect()  # at most HOT_CELLS rows
        often = sorted(often, key=lambda r: tuple((v is not None, v or 0) for v in r))
        sub = F.pmod(F.xxhash64(*same), F.lit(256)).cast("int")
        for k, r in enumerate(often):
            sub = F.when(_equal(same, r), F.lit(256 * (k + 1)) + F.pmod(F.xxhash64("rid"), F.lit(256)).cast("int")).otherwise(sub)
        placed = placed.withColumn("sub", F.when(inside, sub).otherwise(0))
        counts = placed.groupBy("arc", "cell", "sub").agg(F.count(F.lit(1)).alias("n")).collect()  # 256 more for each of at most HOT_CELLS cells and rows
        listed = sorted((r.arc, r.cell, r["sub"], r.n) for r in counts)
    else:
        placed = placed.withColumn("sub", F.lit(0))
        listed = sorted((r.arc, r.cell, 0, r.n) for r in counts)
    sizes, starts = [0] * len(nodes), []
    for a, c, s, n in listed:
        starts.append((a, c, s, sizes[a]))
        sizes[a] += n
    segments = plan(sizes, [s for _, s in nodes], shards)
    table = lambda rows, names, kinds: spark.createDataFrame(pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names))
    offsets = table(starts, ["arc", "cell", "sub", "offset"], [pa.int32(), pa.int64(), pa.int32(), pa.int64()])
    parts = table(segments, ["arc", "begin", "end", "shard", "base"], [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])
    order = Window.partitionBy("arc", "cell", "sub").orderBy(*same, "rid")
    ranked = placed.withColumn("n", F.row_number().over(order) - 1)
    ranked = ranked.join(F.broadcast(offsets), ["arc", "cell", "sub"]).withColumn("rank", F.col("n") + F.col("offset")).drop("n", "offset")
    return (
        ranked.join(F.broadcast(parts), (ranked.arc == parts.arc) & (ranked.rank >= parts.begin) & (ranked.rank < parts.end))
        .withColumn("slot", parts.base + ranked.rank - parts.begin)
        .select(*keys.columns, "shard", "slot")
    )


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", replicas: int = 128) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot (gapless from 0 a shard), grown_shard (null: the law is `rows`).

    Rows of a repeated id are ranked by size and text checksum; rows that agree in all of them are alike.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    out = assign(rows.withColumn("pos", F.xxhash64("doc_id")), shards, replicas)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
