"""Shards of near equal size by best-fit-decreasing packing of indivisible groups.

Groups (here: documents of equal text) are never split. Groups above a fixed share of all bytes are
items on their own; there are at most 1 / share of them, whatever the input. All smaller groups are
dealt by hash into a fixed number of bundles. So at most LARGE + BUNDLES items reach the driver at any
scale. Items, largest first, enter the bin with the tightest sufficient remaining capacity, found in a
balanced tree; for a fixed number of shards the smallest capacity for which they suffice is searched.

Defined results: a null text has no bytes and is grouped with other nulls, apart from empty texts; an
empty table gives no rows; repeated rows are rows of their own with slots of their own; a null doc_id
is kept and sorts first in its cell; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import Scratch, few, ship

#: Groups with more than 1/LARGE of all bytes are items on their own.
LARGE = 4096
#: Smaller groups are dealt into so many bundles.
BUNDLES = 4096
#: Rows of a large group are numbered in so many cells, so that no task holds all of a hot group.
CELLS = 64


class CapacityTree:
    """Bins by remaining capacity in a balanced (left-leaning AA) tree, for tightest-fit lookups.

    Nodes are [capacity, bin, level, left, right]; keys are (capacity, bin), so ties take the lowest bin.
    """

    def __init__(self) -> None:
        self.root: list | None = None

    @staticmethod
    def _skew(t):
        if t and t[3] and t[3][2] == t[2]:
            left = t[3]
            t[3], left[4] = left[4], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[4] and t[4][4] and t[2] == t[4][4][2]:
            right = t[4]
            t[4], right[3] = right[3], t
            right[2] += 1
            return right
        return t

    def insert(self, capacity: int, bin_: int) -> None:
        def put(t):
            if t is None:
                return [capacity, bin_, 1, None, None]
            side = 3 if (capacity, bin_) < (t[0], t[1]) else 4
            t[side] = put(t[side])
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, capacity: int, bin_: int) -> None:
        def cut(t, key):
            if t is None:
                return None
            if key < (t[0], t[1]):
                t[3] = cut(t[3], key)
            elif key > (t[0], t[1]):
                t[4] = cut(t[4], key)
            elif t[3] is None and t[4] is None:
                return None
            elif t[3] is None:
                s = t[4]
                while s[3]:
                    s = s[3]
                t[0], t[1] = s[0], s[1]
                t[4] = cut(t[4], (s[0], s[1]))
            else:
                s = t[3]
                while s[4]:
                    s = s[4]
                t[0], t[1] = s[0], s[1]
                t[3] = cut(t[3], (s[0], s[1]))
            low = min(t[3][2] if t[3] else 0, t[4][2] if t[4] else 0) + 1
            if low < t[2]:
                t[2] = low
                if t[4] and low < t[4][2]:
                    t[4][2] = low
            t = self._skew(t)
            t[4] = self._skew(t[4])
            if t[4]:
                t[4][4] = self._skew(t[4][4])
            t = self._split(t)
            t[4] = self._split(t[4])
            return t

        self.root = cut(self.root, (capacity, bin_))

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, bin) of the smallest remaining capacity that is enough."""
        t, best = self.root, None
        while t:
            if t[0] >= need:
                best, t = (t[0], t[1]), t[3]
            else:
                t = t[4]
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item; an item beyond capacity has a bin to itself. None if over `most` bins are needed."""
    tree, bins, n = CapacityTree(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if found := tree.tightest(sizes[i]):
            room, b = found
            tree.remove(room, b)
        else:
            room, b, n = max(capacity, sizes[i]), n, n + 1
            if most is not None and n > most:
                return None
        bins[i] = b
        tree.insert(room - sizes[i], b)
    return bins


def even_bins(sizes: list[int], k: int) -> list[int]:
    """Best-fit-decreasing into at most k bins with the least capacity that a search finds sufficient."""
    if not sizes:
        return []
    low = max(-(-sum(sizes) // k), max(sizes))
    high = 2 * low
    while (best := best_fit_decreasing(sizes, high, k)) is None:
        high *= 2
    while low < high:
        mid = (low + high) // 2
        if (bins := best_fit_decreasing(sizes, mid, k)) is None:
            low = mid + 1
        else:
            best, high = bins, mid
    return best


def shard(docs: DataFrame, shards: int | None = 16, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. With `shards`, that many of near equal bytes; with
    `capacity` instead, as few of at most that many bytes as best fit finds."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "shard")
    text = F.col("text")
    rows = scratch.keep(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("same"),
        ),
        "rows",
    )
    groups = rows.groupBy("same").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = [(r.same,) for r in groups.where(F.col("bytes") > max(1, total // LARGE)).select("same").collect()]  # under LARGE rows
    hot = F.broadcast(spark.createDataFrame(large, "same string").withColumn("own", F.lit(True)))
    # A bundle is named by its number, a large group by its text's digest and a cell in which its rows are numbered.
    cells = (
        rows.join(hot, "same", "left")
        .withColumn("item", F.when(F.col("own"), F.col("same")).otherwise(F.pmod(F.xxhash64("same"), F.lit(BUNDLES)).cast("string")))
        .withColumn("cell", F.when(F.col("own"), F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))).otherwise(F.lit(0)).cast("int"))
    )
    counted = cells.groupBy("item", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("item", "cell").collect()  # at most BUNDLES + LARGE * CELLS rows
    sizes: dict[str, int] = {}
    for r in counted:
        sizes[r.item] = sizes.get(r.item, 0) + r.bytes
    items = sorted(sizes)
    bins = even_bins([sizes[x] for x in items], shards) if capacity is None else best_fit_decreasing([sizes[x] for x in items], capacity)
    placed = dict(zip(items, bins))
    filled: dict[int, int] = {}
    plan = []
    for r in counted:
        s = placed[r.item]
        plan.append((r.item, r.cell, s, filled.get(s, 0)))
        filled[s] = filled.get(s, 0) + r.n
    table = spark.createDataFrame(plan, "item string, cell int, shard int, before long")
    order = Window.partitionBy("item", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        cells.withColumn("at", F.row_number().over(order))
        .join(few(table, len(plan)), ["item", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))
    )
