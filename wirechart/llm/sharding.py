"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual`` arcs of a ring of 2**32 places, and each row belongs to the arc of its hash. Loads are
bounded by quotas that sum to the number of rows, so counts are at most one apart: an arc's rows fill its own shard in
ring order, and those that overflow a full shard continue clockwise to the next shard with room. A shard more moves
only rows of the arcs that it takes and overflow.

The driver sees one count for each arc, a number set by parameters and not by the data. Rows are ranked within their
arc only, and a slot is the arc's base in its shard plus that rank, so no shard is gathered in a task. Ties and repeated
rows have ranks of their own; null ids hash like any value, null texts have size 8 and checksum 0. Texts of any length are
read whole, an empty table gives no rows, and other columns play no part. Rows equal in id and text share an arc.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS, VIRTUAL = 24, 256
RING = 1 << 32


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[list[int], list[int]]:
    """(sorted begins of arcs, their shards); a shard's places don't depend on the number of others."""
    place = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % RING
    nodes = sorted({place(s, v): s for s in reversed(range(shards)) for v in range(virtual)}.items())
    return [p for p, _ in nodes], [s for _, s in nodes]


def bounded(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, shard, first rank, end rank, slot of the first) from counts of arcs: home shards first, overflow clockwise."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out, over = [0] * shards, [], []

    def give(arc: int, shard: int, first: int, n: int) -> int:
        take = min(n, room[shard] - used[shard])
        if take > 0:
            out.append((arc, shard, first, first + take, used[shard]))
            used[shard] += take
        return max(take, 0)

    for arc, shard in enumerate(owners):
        n = counts.get(arc, 0)
        if n and (took := give(arc, shard, 0, n)) < n:
            over.append((arc, took, n - took))
    for arc, first, n in over:
        step = arc
        while n:
            step = (step + 1) % len(owners)
            took = give(arc, owners[step], first, n)
            first, n = first + took, n - took
    return out


def sharded(documents: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = documents.sparkSession
    begins, owners = ring(shards, virtual)
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("place", F.shiftrightunsigned("hash", 32))
    # the arc of a place: its cell of the ring's grid, then the begins inside that cell
    cells = 1 << (len(begins) * 4).bit_length()
    width = RING // cells
    lower = [(bisect.bisect_right(begins, c * width) - 1) for c in range(cells)]
    inner = [begins[lower[c] + 1 : bisect.bisect_left(begins, (c + 1) * width)] for c in range(cells)]
    table = spark.createDataFrame([(c, lower[c], inner[c]) for c in range(cells)], "cell bigint, lower int, inner array<bigint>").coalesce(1)
    rows = rows.withColumn("cell", F.floor(F.col("place") / width)).join(F.broadcast(table), "cell")
    arc = F.col("lower") + F.size(F.filter("inner", lambda b: b <= F.col("place")))
    rows = rows.select("doc_id", "size", "text_crc32", "hash", F.pmod(arc, F.lit(len(begins))).alias("arc"))
    counts = {r.arc: r["count"] for r in rows.groupBy("arc").count().toLocalIterator()}
    plan = bounded(counts, owners, shards)
    by_arc: dict[int, list] = {}
    for a, s, first, end, slot in plan:
        by_arc.setdefault(a, []).append((s, first, end, slot))
    plan = spark.createDataFrame(sorted(by_arc.items()), "arc int, parts array<struct<shard: int, first: bigint, end: bigint, slot: bigint>>").coalesce(1)
    from pyspark.sql import Window

    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("hash", "doc_id", "text_crc32", "size")).cast("bigint") - 1)
    placed = ranked.join(F.broadcast(plan), "arc").withColumn("part", F.element_at(F.filter("parts", lambda p: (F.col("rank") >= p["first"]) & (F.col("rank") < p["end"])), 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("part.shard").alias("shard"), (F.col("part.slot") + F.col("rank") - F.col("part.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
