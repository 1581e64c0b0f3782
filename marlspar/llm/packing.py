"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) go to shards whole, and every group is packed itself. Items sorted by size enter the bin with
the tightest remaining capacity, found in a balanced tree; the smallest capacity for which that fills no more bins
than asked is found by bisection.

The driver sees the items as runs (size, number of groups of that size): equal items enter the tightest bin one after
another until the next does not fit, so a run takes one step of the tree a bin instead of one an item, with the same
result. Different sizes add up to no more than all bytes, so there are at most sqrt(2 * all bytes) runs. Each run gives
every bin one stretch of its groups at most; groups are ranked within their size by their keys, in blocks, so that
no task ranks all groups of a common size, and find their shard by their rank.

Cases: a null text is an empty one (8 bytes with its overhead, checksum 0); equal sizes are packed in the order
of their ranks; repeated rows belong to one group; an empty table has no rows; columns besides doc_id and text
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, stored

#: Rows of a shard, and groups of one size, are numbered in so many independent blocks.
BLOCKS = 64
#: Groups with over 1/HOT of all rows (so fewer than HOT) are joined by broadcast, as their rows would fill one task.
HOT = 4096


class _Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.level, self.left, self.right = key, 1, None, None


class CapacityTree:
    """An AA tree of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self._root: _Node | None = None

    @staticmethod
    def _skew(t: _Node | None) -> _Node | None:
        if t and t.left and t.left.level == t.level:
            up = t.left
            t.left, up.right = up.right, t
            return up
        return t

    @staticmethod
    def _split(t: _Node | None) -> _Node | None:
        if t and t.right and t.right.right and t.level == t.right.right.level:
            r = t.right
            t.right, r.left = r.left, t
            r.level += 1
            return r
        return t

    def add(self, key: tuple[int, int]) -> None:
        def go(t: _Node | None) -> _Node:
            if t is None:
                return _Node(key)
            if key < t.key:
                t.left = go(t.left)
            else:
                t.right = go(t.right)
            return self._split(self._skew(t))

        self._root = go(self._root)

    def discard(self, key: tuple[int, int]) -> None:
        def go(t: _Node | None, key: tuple[int, int]) -> _Node | None:
            if t is None:
                return None
            if key < t.key:
                t.left = go(t.left, key)
            elif key > t.key:
                t.right = go(t.right, key)
            elif t.left is None and t.right is None:
                return None
            elif t.left is None:
                heir = t.right
                while heir.left:
                    heir = heir.left
                t.key, t.right = heir.key, go(t.right, heir.key)
            else:
                heir = t.left
                while heir.right:
                    heir = heir.right
                t.key, t.left = heir.key, go(t.left, heir.key)
            level = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
            if level < t.level:
                t.level = level
                if t.right and level < t.right.level:
                    t.right.level = level
            t = self._skew(t)
            t.right = self._skew(t.right)
            if t.right:
                t.right.right = self._skew(t.right.right)
            t = self._split(t)
            t.right = self._split(t.right)
            return t

        self._root = go(self._root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least (remaining, bin) with remaining >= size."""
        best, t = None, self._root
        while t:
            if t.key >= (size, -1):
                best, t = t.key, t.left
            else:
                t = t.right
        return best


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, at_most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, bin, number of items) for runs (size, number of items); None if more than `at_most` bins would be needed.

    An item above the capacity gets a bin of its own.
    """
    tree, bins, out = CapacityTree(), 0, []
    for size, left in sorted(runs, reverse=True):
        while left:
            found = tree.tightest(size)
            if found is None:
                if bins == at_most:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            else:
                tree.discard(found)
            # what the bin has left stays the tightest that holds the size, until it does not
            n = min(left, found[0] // size) if size else left
            tree.add((found[0] - n * size, found[1]))
            out.append((size, found[1], n))
            left -= n
    return out


def least_capacity(runs: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Best fit decreasing into `bins` bins, at the smallest capacity that bisection finds to suffice."""
    total, largest = sum(s * n for s, n in runs), max((s for s, _ in runs), default=0)
    low = max(-(-total // bins), largest)
    high, best = low * 2 + 1, None
    while best is None:
        best, high = best_fit_decreasing(runs, high, bins), high * 2
    high //= 2
    while high - low > max(1, low // 20_000):
        middle = (low + high) // 2
        if found := best_fit_decreasing(runs, middle, bins):
            best, high = found, middle
        else:
            low = middle + 1
    return best


def _ranked(groups: DataFrame) -> DataFrame:
    """Adds rank, from 0 among the groups of one size: blocks are ranked apart, then moved by those before."""
    groups = groups.withColumn("_block", F.pmod(F.xxhash64("group_key"), F.lit(BLOCKS)).cast("int"))
    counts = groups.groupBy("bytes", "_block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("bytes").orderBy("_block")) - F.col("n")
    inner = F.row_number().over(Window.partitionBy("bytes", "_block").orderBy("group_key"))
    out = groups.withColumn("_n", inner).join(counts.select("bytes", "_block", before.alias("_before")), ["bytes", "_block"])
    return out.withColumn("rank", F.col("_before") + F.col("_n") - 1).drop("_n", "_before", "_block")


def shard(docs: DataFrame, n_shards: int, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, group_key, shard and slot (gapless in the shard) of every row; sizes nearly equal."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group_key")
    )
    rows = stored(rows, "rows")  # the texts are read once
    # one row for each group, partly summed before the shuffle; read three times
    groups = stored(rows.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "groups")
    runs = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not runs:
        return rows.select("doc_id", "size", "text_crc32", "group_key", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    stretches: dict[int, list[tuple[int, int]]] = {}
    for size, into, n in least_capacity(runs, n_shards):
        own = stretches.setdefault(size, [])
        own.append(((own[-1][0] if own else 0) + n, into))
    # (size, [(rank where the stretch ends, shard)]), at most n_shards stretches a size; AQE broadcasts the table if it is small
    table = spark.createDataFrame([*stretches.items()], "bytes long, stretches array<struct<till: long, shard: int>>")
    alone = F.size("stretches") == 1
    # most sizes go to one shard whole; only the groups of the others are ranked
    groups = groups.join(table, "bytes")
    whole = groups.where(alone).select("group_key", "rows", F.col("stretches")[0].shard.alias("shard"))
    divided = _ranked(groups.where(~alone))
    divided = divided.select("group_key", "rows", F.filter("stretches", lambda x: x.till > F.col("rank"))[0].shard.alias("shard"))
    placed = stored(whole.unionByName(divided), "placed")
    total = placed.agg(F.sum("rows")).first()[0]
    hot = F.col("rows") * HOT > total
    common = placed.where(hot).select("group_key", F.col("shard").alias("_hot"))  # fewer than HOT rows
    rows = rows.join(F.broadcast(common), "group_key", "left")
    rest = rows.where("_hot is null").drop("_hot").join(placed.where(~hot).select("group_key", "shard"), "group_key")
    rows = rows.where("_hot is not null").withColumnRenamed("_hot", "shard").unionByName(rest)
    return with_slots(rows)


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: blocks are numbered apart, then moved by the sizes of those before."""
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(BLOCKS)).cast("int"))
    counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("n")
    counts = counts.select("shard", "_block", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("doc_id", "group_key"))
    out = rows.withColumn("_n", inner).join(F.broadcast(counts), ["shard", "_block"])  # n_shards * BLOCKS rows
    return out.select("doc_id", "size", "text_crc32", "group_key", "shard", (F.col("_before") + F.col("_n") - 1).alias("slot"))
