"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts are indivisible. Sorted by size, each enters the shard with the tightest remaining
capacity that holds it, found in a balanced tree of remaining capacities. For a fixed number of shards
the smallest capacity that suffices is found by bisection, which makes the sizes near equal.

The packing itself is a loop over few items whatever the corpus holds. Groups of at least a
``1 / (shards * GRAIN)``th of all bytes are items of their own; there are at most ``shards * GRAIN`` of them.
The smaller groups are put together by a hash of their text into ``shards * GRAIN`` lots, each an item.
So the driver packs at most ``2 * shards * GRAIN`` items, tables of that many rows go back by broadcast, and
the shards differ by less than a lot or by the one group that is larger than an even share.

Slots are gapless in each shard: rows are numbered in blocks of some thousand, and the blocks' counts
give each block its first slot.

Cases: a null text has no bytes, the size 8, and the CRC of the empty text; it is grouped with empty texts.
Repeated rows are rows of their own in one group. An empty table gives no rows. Other columns are
ignored by ``shard_documents`` unless named in ``keep``.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliant.llm.common import materialise

SHARDS = 24
ROW_BYTES = 8
GRAIN = 256
ROWS_PER_BLOCK = 1_000


class CapacityTree:
    """A treap of (remaining capacity, bin): insert, and take the tightest bin that fits."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.dice = random.Random(0)

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self.dice.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least key with at least ``size`` remaining, or None."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        path, node = None, high
        while node[2] is not None:
            path, node = node, node[2]
        if path is None:
            high = node[3]
        else:
            path[2] = node[3]
        self.root = self._join(low, high)
        return node[0]

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low if high is None else high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high


def best_fit_decreasing(sizes: list[int], capacity: int, limit: int | None = None) -> list[int] | None:
    """The bin of each size, in the order given; None if more than ``limit`` bins are needed.

    A size over the capacity gets a bin of its own.
    """
    tree, bins, placed = CapacityTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            if limit is not None and bins >= limit:
                return None
            found = (max(capacity, sizes[i]), bins)
            bins += 1
        placed[i] = found[1]
        tree.insert((found[0] - sizes[i], found[1]))
    return placed


def pack(sizes: list[int], shards: int) -> list[int]:
    """Bins 0 to ``shards - 1`` by best fit at the least capacity, to one part in 4096, that suffices.

    A size over the even share of what is left to pack has a bin to itself, so that it doesn't widen the others.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    total, bins, alone = sum(sizes), shards, 0
    while alone < len(order) and bins > 1 and sizes[order[alone]] * bins > total:
        total, bins, alone = total - sizes[order[alone]], bins - 1, alone + 1
    rest = order[alone:]
    placed = [0] * len(sizes)
    for bin_, i in enumerate(order[:alone]):
        placed[i] = bin_
    for i, bin_ in zip(rest, _pack_even([sizes[i] for i in rest], bins), strict=True):
        placed[i] = alone + bin_
    return placed


def _pack_even(sizes: list[int], shards: int) -> list[int]:
    if not sizes:
        return []
    total = sum(sizes)
    low = max(-(-total // shards), max(sizes))
    grain = max(1, total // shards // 4096)
    high, step, best = low, grain, best_fit_decreasing(sizes, low, shards)
    while best is None:
        low, high, step = high, high + step, step * 2
        best = best_fit_decreasing(sizes, high, shards)
    while high - low > grain:
        middle = (low + high) // 2
        tried = best_fit_decreasing(sizes, middle, shards)
        if tried is None:
            low = middle
        else:
            high, best = middle, tried
    return best


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, then the columns of ``keep``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        digest.alias("digest"),
        *keep,
    )
    lots = shards * GRAIN
    lot = F.pmod(F.xxhash64("digest"), F.lit(lots)).cast("int")
    groups = materialise(rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-groups")
    total = groups.agg(F.sum("size"), F.sum("n")).first()
    threshold = max(1, (total[0] or 0) // lots)
    # Neither list is longer than `lots`: so many groups of that size at most, and so many lots.
    large = [(bytes(r.digest), r.size) for r in groups.where(F.col("size") > threshold).collect()]
    small = [(r.lot, r.size) for r in groups.where(F.col("size") <= threshold).groupBy(lot.alias("lot")).agg(F.sum("size").alias("size")).collect()]
    large.sort()
    small.sort()
    bins = pack([s for _, s in large] + [s for _, s in small], shards)

    of_group = spark.createDataFrame([(bytearray(d), b) for (d, _), b in zip(large, bins, strict=False)], "digest binary, own int")
    of_lot = spark.createDataFrame([(k, b) for (k, _), b in zip(small, bins[len(large) :], strict=True)], "lot int, shared int")
    placed = (
        rows.join(F.broadcast(of_group), "digest", "left")
        .withColumn("lot", lot)
        .join(F.broadcast(of_lot), "lot", "left")
        .withColumn("shard", F.coalesce("own", "shared"))
    )

    # Number the rows block by block; the key of a block depends on the row alone.
    blocks = max(1, (total[1] or 0) // (shards * ROWS_PER_BLOCK))
    block = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(blocks))
    placed = placed.withColumn("block", block)
    first = (
        placed.groupBy("shard", "block")
        .count()
        .select(
            "shard",
            "block",
            (F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).alias("first"),
        )
    )
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "digest")
    return (
        placed.withColumn("n", F.row_number().over(within) - 1)
        .join(first, ["shard", "block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("n")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            *keep,
        )
    )
