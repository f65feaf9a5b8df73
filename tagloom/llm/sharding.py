"""Consistent-hash ring with virtual nodes and bounded loads.

Each document's key is hashed to a cell of the ring; the cell belongs to the next virtual node clockwise. Keys that find
their shard full go on clockwise to the next shard with room. The bounds add up to the number of rows (the first
``rows mod shards`` shards take one more), so counts differ by at most one and a key moves only if its shard is full.

The walk round the ring works on counts of keys for each virtual node - a table as long as the ring has nodes, whatever the
number of rows - and gives runs of key ranks for each shard; a broadcast join on that bounded table places the rows. A key's
rank in its node is the sum of the counts of the sub-ranges before its own and its rank there; sub-ranges grow in number with
the rows, so no task sorts more than some of them.

Defined results: rows without an id are placed by the checksum and size of their text; ties lie in order of id, size and
checksum; a null text has size 1; repeated rows get slots of their own, and an id that fills more than one sub-range is dealt
over several; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import durable, parts_for

CELLS = 1 << 16


def ring_nodes(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node in ring order; of two nodes on one cell the lower shard keeps it."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual):
            cell = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") % CELLS
            at.setdefault(cell, shard)
    return sorted(at.items())


def node_of_cell(nodes: list[tuple[int, int]]) -> list[int]:
    cells = [c for c, _ in nodes]
    return [bisect.bisect_left(cells, c) % len(cells) for c in range(CELLS)]


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(node, first rank, end rank, shard, first slot): runs of each node's keys by rank, after overflow.

    First every node's keys claim their own shard in ring order; what a full shard can't take moves on together, node by
    node clockwise, until a shard with room takes it.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, runs, left = [0] * shards, [], {}

    def place(node: int, first: int, end: int, shard: int) -> int:
        n = min(end - first, room[shard] - filled[shard])
        if n > 0:
            runs.append((node, first, first + n, shard, filled[shard]))
            filled[shard] += n
        return first + max(n, 0)

    for node, (_, shard) in enumerate(nodes):
        first = place(node, 0, counts.get(node, 0), shard)
        if first < counts.get(node, 0):
            left[node] = first
    for node, first in left.items():
        step = node
        while first < counts[node]:
            step = (step + 1) % len(nodes)
            first = place(node, first, counts[node], nodes[step][1])
    return runs


FEW_HOT = 100_000  # more hot sub-ranges than this are shuffled instead of broadcast


def shard_bounded_ring(docs: DataFrame, shards: int = 16, virtual: int = 64, rows_per_window: int = 5_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    nodes = ring_nodes(shards, virtual)
    cells = spark.createDataFrame(list(enumerate(node_of_cell(nodes))), "cell int, node int")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("doc_id", "text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    keyed = named.withColumn("key", key).withColumn("cell", F.pmod("key", F.lit(CELLS)).cast("int")).withColumn("turn", F.monotonically_increasing_id())
    placed = durable(keyed.join(F.broadcast(cells), "cell").drop("cell"), "ring")  # the cell table has 65,536 rows, always
    counts = {r["node"]: r["n"] for r in placed.groupBy("node").agg(F.count("*").alias("n")).collect()}  # as long as the ring
    runs = spark.createDataFrame(walk(counts, nodes, shards), "node int, first long, end long, shard int, first_slot long")
    # ranks within a node: sub-ranges of the keys' hash, as many as the rows need; a sub-range that one key fills is dealt by row
    subs = max(16, parts_for(sum(counts.values()), rows_per_window * len(nodes)))
    ranged = placed.withColumn("sub", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(subs)))
    each = ranged.groupBy("node", "sub").agg(F.count("*").alias("n"))
    hot = each.where(F.col("n") > 4 * rows_per_window).select("node", "sub", F.ceil(F.col("n") / rows_per_window).cast("long").alias("parts"))
    many = hot.limit(FEW_HOT + 1).count()
    hot = F.broadcast(hot) if many <= FEW_HOT else hot
    split = durable(ranged.join(hot, ["node", "sub"], "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("turn"), F.col("parts"))).otherwise(0)).drop("parts", "turn"), "split") if many else ranged.withColumn("part", F.lit(0).cast("long")).drop("turn")
    windows = split.groupBy("node", "sub", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("node").orderBy("sub", "part").rowsBetween(Window.unboundedPreceding, -1))  # over counts, not rows
    base = windows.select("node", "sub", "part", F.coalesce(before, F.lit(0)).alias("before"))
    keys = ["node", "sub", "part"]
    order = Window.partitionBy(*keys).orderBy("key", "doc_id", "size", "text_crc32")
    ranked = split.withColumn("place", F.row_number().over(order).cast("long") - 1).join(base, keys).withColumn("rank", F.col("before") + F.col("place")).alias("k")
    on = (F.col("k.node") == F.col("r.node")) & (F.col("k.rank") >= F.col("r.first")) & (F.col("k.rank") < F.col("r.end"))
    return ranked.join(F.broadcast(runs.alias("r")), on).select(  # at most nodes + nodes x shards runs
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("first_slot") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
