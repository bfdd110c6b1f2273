"""Sharding by Karmarkar-Karp differencing: balanced bytes for indivisible groups of equal texts.

A partial partition holds ``shards`` piles. Differencing takes the two with the largest spread and joins them in opposite order, so that the
heaviest pile of one meets the lightest of the other. It is done in a tree of tasks: groups are spread over nodes by hash, each node
differences its own to ``shards`` piles, and the piles are the items of the next level, up to one node with at most ``PER_NODE`` items, whose piles are the
shards. An item that outweighs its node's mean pile goes up as it is, to meet enough others. The shards then go down the tree by joins; the driver
sees only counts.

Law: ``bytes``. Groups of equal texts always stay whole, so the heaviest group sets a bound: if it outweighs a mean shard, it has a shard
to itself and the others are balanced.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, stored

#: Items that one task differences; nodes under the top, so that it has fine enough items to balance heavy ones.
PER_NODE = 50_000
BELOW_TOP = 1_000


def difference(sums: list[np.ndarray], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions (each ``shards`` sums): for every partial its piles' shards, and the shards' sums."""
    n = len(sums)
    if not n:
        return np.zeros((0, shards), np.int16), np.zeros(shards, np.int64)
    sums = list(sums)
    joins: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    heap = [(-int(s.max() - s.min()), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        pa_, pb = np.argsort(-sums[a], kind="stable"), np.argsort(sums[b], kind="stable")
        joined = sums[a][pa_] + sums[b][pb]
        sums[a] = sums[b] = None  # only the joined partial is needed
        sums.append(joined)
        joins.append((a, b, pa_, pb))
        heapq.heappush(heap, (-int(joined.max() - joined.min()), len(sums) - 1))
    where: list[np.ndarray | None] = [None] * len(sums)
    where[-1] = np.arange(shards, dtype=np.int16)
    for k in range(len(joins) - 1, -1, -1):
        a, b, pa_, pb = joins[k]
        top, where[n + k] = where[n + k], None
        where[a], where[b] = np.empty_like(top), np.empty_like(top)
        where[a][pa_], where[b][pb] = top, top
    return np.array(where[:n]), sums[-1]


def spread(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The pile of each of a block's groups, and the piles' sums: at first every group is a partial with one pile."""
    singles = np.zeros((len(sizes), shards), np.int64)
    singles[:, 0] = sizes
    piles, total = difference(list(singles), shards)
    return piles[:, 0], total


def placed(groups: DataFrame, shards: int) -> DataFrame:
    """``groups`` (key, rows, bytes) with the ``shard`` of each."""

    def node(level: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            ids, sizes = table.column("id").to_pylist(), table.column("bytes").to_numpy()
            order = np.array(sorted(range(len(ids)), key=ids.__getitem__))
            light = order[sizes[order] * shards <= sizes.sum()]
            up = list(ids)  # an item that outweighs a mean pile goes up as it is
            for i, pile in zip(light.tolist(), spread(sizes[light], shards)[0].tolist()):
                up[i] = b"%d:%d:%d" % (level, table.column("node")[0].as_py(), pile)
            return table.select(["id", "bytes"]).append_column("up", pa.array(up, pa.binary()))

        return run

    def top(table: pa.Table) -> pa.Table:
        ids, sizes = table.column("id").to_pylist(), table.column("bytes").to_numpy()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        shard_of = np.empty(len(ids), np.int32)
        shard_of[order] = spread(sizes[order], shards)[0]
        return table.select(["id"]).append_column("shard", pa.array(shard_of))

    items = groups.select(F.col("key").alias("id"), "bytes")
    n, levels = items.count(), []
    while n > PER_NODE:
        nodes = max(-(-n // PER_NODE), min(BELOW_TOP, n // (10 * shards)))
        dealt = items.withColumn("node", F.pmod(F.xxhash64("id"), F.lit(nodes)))
        levels.append(stored(dealt.groupBy("node").applyInArrow(node(len(levels)), "id binary, bytes bigint, up binary"), "sharding-tree"))
        items = levels[-1].groupBy(F.col("up").alias("id")).agg(F.sum("bytes").alias("bytes"))
        n = items.count()
    known = stored(items.withColumn("node", F.pmod(F.xxhash64("id"), F.lit(1))).groupBy("node").applyInArrow(top, "id binary, shard int"), "sharding-top")
    for level in reversed(levels):
        known = level.select("id", "up").join(known.withColumnRenamed("id", "up"), "up").select("id", "shard")
    return groups.join(known, groups.key == known.id).select("key", "rows", "shard")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` per row of ``(doc_id, text)``; size is the text's bytes plus 8.

    A null text has no bytes, and is of one group with the empty one. Groups are whole: of equal texts, repeated rows among them, all rows are in one shard. Slots
    number each shard's rows without gaps.
    """
    text = F.coalesce("text", F.lit(""))
    raw = text.cast("binary")
    rows = stored(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).cast("int").alias("salt")), "sharding")
    groups = stored(rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")), "sharding-groups")
    sharded = stored(attach(rows, stored(placed(groups, shards), "sharding-shards"), "key").select("doc_id", "size", "text_crc32", "shard", "salt"), "sharding-rows")
    # Slots in two steps: within (shard, bucket of salts), then offsets from the buckets' counts.
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bucket = F.pmod(F.col("salt"), F.lit(max(8, min(4096, total // (64 << 20))))).cast("int")
    counts = sharded.groupBy("shard", bucket.alias("bucket")).count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).drop("count")
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return sharded.withColumn("bucket", bucket).join(F.broadcast(before), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.row_number().over(order) - 1 + F.col("before")).cast("long").alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
