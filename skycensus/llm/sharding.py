"""Sharding by best-fit-decreasing bin packing.

Indivisible groups (equal texts; null is a text of its own) enter, largest first, the shard with the tightest room that
holds them, found in a balanced tree. Sizes are rounded up to 12 leading bits (under 0.05 %), and groups of one size are
alike to the packing, so it runs over the counts by size: at most 2048 sizes for each power of two, however many groups
there are. Every group keeps whole but one that is over a whole shard itself (all bytes / shards): it can't, and is cut into
as few pieces as fit, each an item of its own. Law: `bytes`, sizes near equal. Slots number a shard's rows without gaps.
Rows that repeat an id are rows of their own. Empty input gives no rows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycensus.llm.common import cut, table

SHARDS, SIZE_BITS = 24, 12
#: Items over this share of the bytes or rows (at most twice as many) are joined by broadcast, so no key of the shuffled join is hot.
LARGE = 9600


class Tree:
    """A balanced search tree (treap) of (room, bin), for the least entry not under a key."""

    def __init__(self):
        self.root, self.random = None, random.Random(5)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            return [node[0], node[1], node[2], a], b
        a, b = self._split(node[2], key)
        return a, [node[0], node[1], b, node[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]

    def add(self, key) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, self.random.random(), None, None]), b)

    def take(self, room):
        """Remove and return the tightest entry with at least this room, or None."""
        a, b = self._split(self.root, (room, -1))
        found, b = self._first(b)
        self.root = self._merge(a, b)
        return found

    def _first(self, node):
        if node is None:
            return None, None
        if node[2] is None:
            return node[0], node[3]
        found, rest = self._first(node[2])
        return found, [node[0], node[1], rest, node[3]]


def pack(items: list[tuple[int, object]], capacity: int) -> tuple[dict, int]:
    """Bin of each item, largest first, and how many bins of this capacity it took."""
    order = sorted(items, key=lambda x: (-x[0], str(x[1])))
    runs, bins = pack_counts([(size, 1) for size, _ in order], capacity)
    return {order[k][1]: shard for k, _, _, shard in runs}, bins


def pack_counts(counts: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best fit of n items of each (size, n), largest sizes first: (place in counts, first item, items, bin), and the bins.

    The bin that fits an item best goes on to fit its equals best while they fit, so equals enter by runs.
    """
    tree, out, bins = Tree(), [], 0
    for k, (size, n) in enumerate(counts):
        first = 0
        while first < n:
            found = tree.take(size)
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
            some = min(n - first, found[0] // size)
            out.append((k, first, some, found[1]))
            tree.add((found[0] - some * size, found[1]))
            first += some
    return out, bins


def tightest(counts: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Packing into at most `bins` at the least capacity that bisection finds."""
    low = max([-(-sum(s * n for s, n in counts) // bins), *(s for s, _ in counts)], default=1)
    high, best = 2 * low, pack_counts(counts, 2 * low)[0]
    got, n = pack_counts(counts, low)
    if n <= bins:
        return got
    while high - low > max(1, low // 5000):
        mid = (low + high) // 2
        got, n = pack_counts(counts, mid)
        if n <= bins:
            high, best = mid, got
        else:
            low = mid
    return best


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds rank, gapless from 0 within by: rows are numbered within each part, and parts follow each other."""
    counts = rows.groupBy(*by, "part").agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*by, "part", F.coalesce(earlier, F.lit(0)).alias("__start"))
    at = F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order))
    return rows.withColumn("rank", at).join(starts, [*by, "part"]).withColumn("rank", F.col("rank") - 1 + F.col("__start")).drop("__start")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.md5(F.encode("text", "utf-8")), F.lit("null"))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), key.alias("key")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # over a checkpoint this number stays
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share = max(1, -(-total // shards))
    huge = cut(rows.groupBy("key").agg(F.sum("size").alias("g"), F.max("size").alias("one")).filter(F.col("g") > share).select("key", F.greatest(F.lit(1), F.floor(share / F.col("one"))).alias("each")))  # under `shards` rows
    rows = rows.join(F.broadcast(huge), "key", "left")
    cutting = ranked(rows.filter("each is not null").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(max(1, count // 20_000)))), ["key"], ["row"])
    cutting = cutting.withColumn("key", F.concat_ws("-", "key", F.floor(F.col("rank") / F.col("each"))))
    rows = rows.filter("each is null").unionByName(cutting.drop("part", "rank")).drop("each")

    items = rows.groupBy("key").agg(F.sum("size").alias("g"), F.count("*").alias("n"))
    low = F.greatest(F.length(F.bin("g")) - SIZE_BITS, F.lit(0))
    items = items.withColumn("low", low).withColumn("rounded", F.expr("shiftleft(shiftright(g + shiftleft(1L, low) - 1, low), low)"))
    items = cut(items.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(max(1, count // 20_000)))).drop("low"))
    sizes = sorted(((r[0], r[1]) for r in items.groupBy("rounded").agg(F.count("*")).toLocalIterator()), reverse=True)
    runs = docs.sparkSession.createDataFrame([(sizes[k][0], a, a + n, b) for k, a, n, b in tightest(sizes, shards)], "rounded long, first long, end long, shard int")
    at = ranked(items, ["rounded"], ["key"])
    bins = cut(at.join(F.broadcast(runs), "rounded").filter("first <= rank and rank < end").select("key", "g", "n", "shard"))
    hot = (F.col("g") > total / LARGE) | (F.col("n") > count / LARGE)
    found = rows.join(F.broadcast(bins.filter(hot).select("key", "shard")), "key", "left")
    placed = found.filter("shard is not null").unionByName(found.filter("shard is null").drop("shard").join(bins.filter(~hot).select("key", "shard"), "key")).drop("key")

    parts = max(1, -(-count // (shards * 20_000)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    return ranked(placed, ["shard"], ["doc_id", "text_crc32", "row"]).select("doc_id", "size", "text_crc32", "shard", F.col("rank").cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
