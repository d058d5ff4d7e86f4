"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells. Each shard owns ``vnodes`` points on cell boundaries; the cells
from a point up to the next one form an arc and prefer the arc's shard, then the next distinct
shards clockwise. A document's cell comes from a hash of its id and text digest. Shards have a row
capacity, ``ceil((1 + slack) * rows / shards)``, or with ``slack = 0`` exactly the floor or the
ceiling of the mean. Where a shard is full, the keys that don't fit continue clockwise.

Only the number of rows in each cell (at most ``CELLS`` integers, whatever the input) reaches the
driver, which plans which stretch of which cell goes where. Rows are shuffled once, by cell, without
their texts. Cells are filled by a hash, so a hot source or group of copies spreads over all of them.

Defined results: a null text has size 16 and digest 0; null or repeated ids are rows like any other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(first cell, shard) of every arc, clockwise. A shard's points don't depend on how many shards there are,
    but for the rare point whose cell is taken, which moves to the next free one."""
    if not 0 < shards * vnodes <= CELLS // 2:
        raise ValueError(f"shards * vnodes must be in 1..{CELLS // 2}")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest()) % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(counts: dict[int, int], shards: int, vnodes: int, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Rows (cell, lo, hi, shard, slot of lo): ranks lo..hi-1 of the cell go to consecutive slots of the shard."""
    arcs = ring(shards, vnodes)
    starts = [c for c, _ in arcs]
    cells: list[list[tuple[int, int]]] = [[] for _ in arcs]
    for cell, n in sorted(counts.items()):
        cells[bisect.bisect_right(starts, cell) - 1].append((cell, n))  # before the first point: the last arc
    left = [sum(n for _, n in cs) for cs in cells]
    room, load = capacities(sum(left), shards, slack), [0] * shards
    at = list(range(len(arcs)))  # the ring point each arc's remaining keys have come to
    tried: list[set[int]] = [set() for _ in arcs]
    pieces: list[list[tuple[int, int, int]]] = [[] for _ in arcs]  # (rows, shard, slot)
    while any(left):
        for a in range(len(arcs)):
            if not left[a]:
                continue
            while arcs[at[a]][1] in tried[a]:
                at[a] = (at[a] + 1) % len(arcs)
            shard = arcs[at[a]][1]
            tried[a].add(shard)
            if take := min(left[a], room[shard] - load[shard]):
                pieces[a].append((take, shard, load[shard]))
                load[shard] += take
                left[a] -= take
    out = []
    for cs, ps in zip(cells, pieces, strict=True):
        k = used = 0
        for cell, n in cs:
            done = 0
            while done < n:
                rows, shard, slot = ps[k]
                step = min(n - done, rows - used)
                out.append((cell, done, done + step, shard, slot + used))
                done, used = done + step, used + step
                if used == rows:
                    k, used = k + 1, 0
    return out


def shard_documents(docs: DataFrame, shards: int = 40, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row. With slack 0, shards differ by one row at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("_h", F.xxhash64("doc_id", "text_crc32"))
    rows = rows.withColumn("_cell", F.pmod("_h", F.lit(CELLS)).cast("int"))
    counts = {r["_cell"]: r["count"] for r in rows.groupBy("_cell").count().collect()}  # CELLS rows at most
    stretches = docs.sparkSession.createDataFrame(
        plan(counts, shards, vnodes, slack), "_cell int, _lo long, _hi long, shard int, _slot long"
    )
    ranked = rows.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_h", "doc_id", "text_crc32", "size")) - 1
    )
    return ranked.join(
        stretches,
        (ranked["_cell"] == stretches["_cell"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")),
    ).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot")
    )


def op1_sharding(spark, sf_dir):
    from .common import table

    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
