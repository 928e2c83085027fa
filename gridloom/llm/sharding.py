"""Sharding by a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only.

Each shard owns points on the ring; a text belongs to the next point clockwise of its digest, so equal texts are one
group and meet in one shard while there is room. A shard's load is bounded by its share of the rows. The rows of an
arc beyond its shard's bound continue clockwise to the next shards with room. Arcs are as many as points, so how many
rows of each go where is worked out from the arcs' counts alone; then rows find their shard by their rank in the arc.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ranked, written

SHARDS = 8
POINTS = 64
CELL_BITS = 20


def ring(shards: int = SHARDS, points: int = POINTS) -> list[tuple[int, int]]:
    """(position, shard), ascending; positions are 32 bits of a digest, so another shard count leaves them in place."""
    at = lambda s, p: int(hashlib.md5(f"shard {s} point {p}".encode()).hexdigest()[:8], 16)
    return sorted((at(s, p), s) for s in range(shards) for p in range(points))


def arc(position: Column, points: list[tuple[int, int]]) -> Column:
    """Number of the first ring point at or after a 32-bit position; past the last point the first follows."""
    cells: list[list[int]] = [[] for _ in range(1 << (32 - CELL_BITS))]
    for p, _ in points:
        cells[p >> CELL_BITS].append(p)
    before = [0]
    for c in cells:
        before.append(before[-1] + len(c))
    starts = F.expr(f"array({', '.join(map(str, before[:-1]))})")
    inside = F.expr("array(" + ", ".join("array(" + ", ".join(f"{p}L" for p in c) + ")" if c else "cast(array() as array<bigint>)" for c in cells) + ")")
    cell = F.shiftright(position, CELL_BITS).cast("int")
    return (F.get(starts, cell) + F.size(F.filter(F.get(inside, cell), lambda p: p < position))) % len(points)


def moves(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the rows of each arc go under the bound.

    Shards first fill from their own arcs in ring order; then the overflow of each arc, in ring order, continues
    clockwise. The bounds add up to the rows, so all find room and counts differ by one at most.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    taken = [0] * shards
    out, over = [], []

    def put(a: int, rank: int, n: int, s: int) -> None:
        if n:
            out.append((a, rank, rank + n, s, taken[s]))
            taken[s] += n
            room[s] -= n

    for a, (_, s) in enumerate(points):
        n = counts.get(a, 0)
        kept = min(n, room[s])
        put(a, 0, kept, s)
        if n > kept:
            over.append((a, kept, n))
    for a, rank, n in over:
        k = a
        while rank < n:
            k = (k + 1) % len(points)
            s = points[k][1]
            some = min(room[s], n - rank)
            put(a, rank, some, s)
            rank += some
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row of `docs`.

    The law is `rows`: shards hold equally many rows, or one more in the lower ones. Null texts count as empty ones.
    Within an arc rows are ranked by digest, doc_id (nulls first) and size, so equal texts stay side by side and a large
    group is cut only where a shard is full. Repeated rows are placed each, an empty table gives an empty one, further
    columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    nodes = ring(shards, points)
    rows = docs.select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"))
    position = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    rows = written(rows.withColumn("arc", arc(position, nodes)), "ring-positions")
    counts = {r.arc: r.n for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per point at most
    way = "arc int, low long, high long, shard int, slot0 long"
    steps = docs.sparkSession.createDataFrame([tuple(m) for m in moves(counts, nodes, shards)], way).groupBy("arc").agg(F.collect_list(F.struct("low", "high", "shard", "slot0")).alias("steps"))
    placed = ranked(rows, ["arc"], [F.col("digest"), F.col("doc_id"), F.col("size")], "rank", sum(counts.values()))
    # at most one row per point and shard, so the broadcast is bounded by the ring
    placed = placed.join(F.broadcast(steps), "arc")
    step = F.filter("steps", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0]
    placed = placed.withColumn("step", step)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "step.shard", (F.col("step.slot0") + F.col("rank") - F.col("step.low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
