"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Rows hash to one of a fixed number of cells on a ring; each shard has many virtual nodes there, and a cell belongs to the
next virtual node clockwise. Cells arrive in a fixed pseudo-random order. A shard takes rows up to its capacity; rows of a
cell that find it full continue clockwise to the next shard with room. With slack 0 the capacities add up to the number of
rows, so counts differ by one at most; with more slack, fewer rows leave their first shard and fewer move when shards are added.

Only counts of cells come to the driver (CELLS numbers at most, whatever the input), and only the plan made of them goes
back (a row for each cell, and one more for each shard that fills up or passes through, CELLS + CELLS // 4 in practice; its
size is checked). Each row is then placed by its rank within its cell.

A null id takes its place by its text. Rows of one id lie in one cell; equal rows share it too and get slots of their own.
A null text counts no bytes. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16
VNODES = 128
#: Rows of a plan that may be broadcast (40 bytes each).
PLAN_ROWS = 4 * CELLS


def _point(*what: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(what).encode(), digest_size=8).digest(), "big")


def virtual_nodes(shards: int, vnodes: int, cells: int) -> list[tuple[int, int, int]]:
    """(position, tie, shard), clockwise."""
    return sorted((_point("node", s, v) % cells, _point("tie", s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [-(-int(rows * (1 + slack) * 1_000_000) // (shards * 1_000_000)) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(counts: dict[int, int], shards: int, slack: float = 0.0, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first): the ring with bounded loads, over counts of cells."""
    nodes = virtual_nodes(shards, vnodes, cells)
    positions = [p for p, _, _ in nodes]
    room = capacities(sum(counts.values()), shards, slack)
    filled = [0] * shards
    after = list(range(1, len(nodes) + 1))  # the next virtual node that may have room, shortened as shards fill

    def open_from(i: int) -> int:
        path = []
        for _ in range(2):
            while i < len(nodes) and not room[nodes[i][2]]:
                path.append(i)
                i = after[i]
            if i < len(nodes):
                break
            for p in path:
                after[p] = len(nodes)
            path, i = [], 0
        for p in path:
            after[p] = i
        return i

    out = []
    for cell in sorted(counts, key=lambda c: _point("cell", c)):
        rank, left = 0, counts[cell]
        at = bisect_left(positions, cell) % len(nodes)
        while left:
            at = open_from(at)
            shard = nodes[at][2]
            take = min(left, room[shard])
            out.append((cell, rank, rank + take, shard, filled[shard]))
            room[shard] -= take
            filled[shard] += take
            rank += take
            left -= take
    return out


def sharded(docs: DataFrame, shards: int = 24, slack: float = 0.0, vnodes: int = VNODES, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): size is the text's UTF-8 bytes plus 8; slots are gapless from 0 within a shard."""
    spark = docs.sparkSession
    key = F.coalesce(F.xxhash64(F.lit(1), id_col), F.lit(0)) if dict(docs.dtypes)[id_col] == "string" else F.xxhash64(F.lit(1), F.col(id_col).cast("long"))
    cell = F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(2), text_col)).otherwise(key), F.lit(cells)).cast("int")
    counts = dict(map(tuple, docs.groupBy(cell.alias("cell")).count().collect()))
    made = plan(counts, shards, slack, vnodes, cells)
    if len(made) > PLAN_ROWS:
        raise ValueError(f"the plan has {len(made)} rows; take fewer cells or virtual nodes")
    places = spark.createDataFrame(made, "cell int, low long, high long, shard int, base long")
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col), (F.length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), cell.alias("cell"))
    within = Window.partitionBy("cell").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size")
    ranked = rows.withColumn("rank", (F.row_number().over(within) - 1).cast("long"))
    near = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(F.broadcast(places), "cell").filter(near)
    return placed.select(id_col, "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))
