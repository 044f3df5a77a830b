"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.  DataFrame functions only.

Every shard owns ``vnodes`` points of a ring of 65,536 slots.  A row's key hashes to a slot and belongs to the arc that
ends at the next point clockwise.  A shard takes rows up to its capacity; what an arc holds beyond it moves on to the
points that follow, until a shard has room.  With ``slack`` 0 the capacities are the even shares (at most one row
apart); a larger slack lets shards differ by that share and moves fewer rows.

What the driver sees is one count per arc (shards x vnodes rows); rows themselves are placed by a rank within their
arc, which is computed in cells of bounded size.

Defined cases: a null key hashes like any value, and its rows are spread by their other columns; wholly equal rows are
counted before they are dealt and get separate slots, long runs of them in parts; a null text has no bytes (size 1, checksum 0); an empty table
gives an empty result; other columns of the input are not carried.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, counted_classes, enumerated, literal_table, running_offsets

SLOTS = 65_536


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(slot, shard) of each virtual node, by slot; two that fall together move on to the next free slot."""
    if shards * vnodes > SLOTS // 4:
        raise ValueError("too many virtual nodes for the ring")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            slot = xxhash.xxh64_intdigest(f"{shard}/{v}") % SLOTS
            while slot in taken:
                slot = (slot + 1) % SLOTS
            taken[slot] = shard
    return sorted(taken.items())


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-(-int(rows * (1 + slack)) // shards) + 1] * shards


def flow(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each arc go: (arc, from rank, to rank, shard, first slot).

    In step d each arc in turn offers what it has left to the point d places clockwise.
    """
    left, room, used = list(counts), list(room), [0] * len(room)
    out, waiting = [], [a for a, n in enumerate(counts) if n]
    for step in range(len(owners)):
        for arc in waiting:
            shard = owners[(arc + step) % len(owners)]
            n = min(left[arc], room[shard])
            if n:
                lo = counts[arc] - left[arc]
                out.append((arc, lo, lo + n, shard, used[shard]))
                left[arc] -= n
                room[shard] -= n
                used[shard] += n
        waiting = [a for a in waiting if left[a]]
        if not waiting:
            break
    return out


def ring_shards(df: DataFrame, key: str, ties: list[str], shards: int = 16, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Rows of ``key`` and ``ties`` with ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    spark: SparkSession = df.sparkSession
    scratch = Scratch(spark, "ring")
    cols = [key, *ties]
    rows = scratch.keep(counted_classes(df.select(*cols)), "rows")
    most = rows.agg(F.max("copies")).first()[0] or 0
    points = ring_points(shards, vnodes)
    owners = [s for _, s in points]
    arcs, lo = [], 0
    for arc, (slot, _) in enumerate(points):
        arcs.append((arc, lo, slot))
        lo = slot + 1
    if lo < SLOTS:
        arcs.append((0, lo, SLOTS - 1))
    # 65,536 slim rows at any input size
    ring = literal_table(spark, arcs, "arc int, lo int, hi int").select("arc", F.explode(F.sequence("lo", "hi")).alias("ring_slot"))
    placed = rows.withColumn("ring_slot", F.shiftrightunsigned(F.xxhash64(key), 48).cast("int")).join(F.broadcast(ring), "ring_slot").drop("ring_slot")
    counts = [0] * len(points)
    for arc, n in placed.groupBy("arc").agg(F.sum("copies")).collect():  # at most shards x vnodes rows
        counts[arc] = n
    moves = flow(counts, owners, capacities(sum(counts), shards, slack))
    if not moves:
        return rows.select(*cols, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    # at most shards x arcs rows
    moves_df = F.broadcast(literal_table(spark, moves, "arc int, lo bigint, hi bigint, shard int, first bigint"))
    ranked = running_offsets(placed, "arc", cols, "copies")
    end = F.col("start") + F.col("copies")
    met = ranked.join(moves_df, "arc").where((F.col("start") < F.col("hi")) & (end > F.col("lo")))
    met = met.select(*cols, "shard", (F.col("first") - F.col("lo")).alias("_to"), F.greatest("start", "lo").alias("_lo"), F.least(end, "hi").alias("_hi"))
    return enumerated(met, F.col("_lo"), F.col("_hi"), "_rank", most).select(*cols, "shard", (F.col("_rank") + F.col("_to")).cast("long").alias("slot"))


def op7_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 shards by the `rows` law: counts at most one apart, keys placed by the ring."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = ring_shards(sized, "doc_id", ["size", "text_crc32"], shards=16, vnodes=64)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
