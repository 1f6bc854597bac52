"""The buffer as tables: segments, their expiry, and what happens as bytes run short."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bytes are summed up within so much arrival time, then over those spans of time.
STRETCH_US = 3_600_000_000


def with_segments(spans: DataFrame, shard, segment_bytes: int) -> DataFrame:
    """spans with shard and gen: a shard's spans in order of arrival fill segments of segment_bytes; a span belongs
    to the segment in which its first byte lies. A task orders no more than an hour of a shard; what lies before an
    hour is summed over hours, of which there are few."""
    keys = ["instance", "shard", "__stretch"]
    dealt = spans.withColumn("shard", shard).withColumn("__stretch", F.floor(F.col("arrival_us") / STRETCH_US))
    earlier = Window.partitionBy("instance", "shard").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys).agg(F.sum("size_bytes").alias("bytes")).select(*keys, F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("__earlier"))
    order = Window.partitionBy(*keys).orderBy("arrival_us", "ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__earlier") + F.coalesce(F.sum("size_bytes").over(order), F.lit(0))
    return dealt.join(sums, keys).withColumn("gen", F.floor(before / segment_bytes).cast("int")).drop("__stretch", "__earlier")


def segments(spans: DataFrame) -> DataFrame:
    """instance, shard, gen, t_min_us, t_max_us, bytes, n, finalized: the newest of a shard is still written to."""
    newest = Window.partitionBy("instance", "shard").orderBy(F.desc("gen"))
    held = spans.groupBy("instance", "shard", "gen").agg(F.min("arrival_us").alias("t_min_us"), F.max("arrival_us").alias("t_max_us"), F.sum("size_bytes").cast("bigint").alias("bytes"), F.count("*").alias("n"))
    return held.withColumn("finalized", F.row_number().over(newest) > 1)


def expired_segments(held: DataFrame, now, window: int) -> DataFrame:
    """Those whose newest span is older than the window."""
    return held.where(F.col("t_max_us") < now - window)


def early_expiry(held: DataFrame, now, floor: int, limit: int, total: int | None = None) -> DataFrame:
    """held with sacrificed: as long as an instance has more bytes than limit, its oldest finalized segment goes, if
    its newest span is older than floor. The order is by time, shard and generation; the first that is too young
    ends it."""
    each = Window.partitionBy("instance")
    order = each.orderBy("t_max_us", "shard", "gen")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    may = F.col("finalized") & (F.col("t_max_us") < now - floor)
    out = held.withColumn("total", F.sum("bytes").over(each) if total is None else F.lit(total))
    # Segments that are still written to are passed over, they hold back nothing.
    out = out.withColumn("gone", F.coalesce(F.sum(F.when(may, F.col("bytes"))).over(before), F.lit(0)))
    blocked = F.coalesce(F.max(F.when(F.col("finalized") & ~may, 1)).over(before), F.lit(0)) == 1
    return out.withColumn("sacrificed", may & ~blocked & (F.col("total") - F.col("gone") > limit)).drop("total", "gone")


def shed_causes(held: DataFrame, now, floor: int, limit: int) -> DataFrame:
    """For each instance and shard why it refuses fragments once early expiry has done what it may: null if bytes are
    within limit, floor_protected if its oldest finalized segment is too young, nothing_reclaimable if it has none."""
    kept = early_expiry(held, now, floor, limit).where("not sacrificed")
    each = Window.partitionBy("instance")
    left = kept.withColumn("total", F.sum("bytes").over(each)).groupBy("instance", "shard").agg(F.max("total").alias("total"), F.max(F.col("finalized").cast("int")).alias("any"))
    cause = F.when(F.col("total") <= limit, F.lit(None)).when(F.col("any") == 1, "floor_protected").otherwise("nothing_reclaimable")
    return left.select("instance", "shard", F.col("total").alias("bytes_left"), cause.alias("cause"))


def effective_window(held: DataFrame, now, window: int) -> DataFrame:
    """instance and effective_window_s: the age, in whole seconds, of the newest span of the oldest finalized segment
    of the shard where that is least; the window where no shard has one."""
    oldest = held.groupBy("instance", "shard").agg(F.min(F.when(F.col("finalized"), F.struct("gen", "t_max_us"))).alias("o"))
    age = F.when(F.col("o").isNotNull(), F.least(F.greatest(now - F.col("o.t_max_us"), F.lit(0)), F.lit(window)))
    return oldest.groupBy("instance").agg(F.floor(F.coalesce(F.min(age), F.lit(window)) / 1_000_000).cast("bigint").alias("effective_window_s"))


def merged_intents(intents: DataFrame) -> DataFrame:
    """One row per instance and trace: what is owed taken together, the first reason that isn't 0 and the first deadline."""
    return intents.groupBy("instance", "trace_id").agg(
        F.bit_or("need").alias("need"),
        F.coalesce(F.min(F.when(F.col("reason") != 0, F.struct("ord", "reason")))["reason"], F.lit(0)).cast("int").alias("reason"),
        F.min(F.when(F.col("deadline_us") != 0, F.struct("ord", "deadline_us")))["deadline_us"].alias("deadline_us"),
        F.min("ord").alias("ord"),
    )


def drained(intents: DataFrame, capacity: int) -> DataFrame:
    """The oldest intents of each instance, as many as capacity."""
    order = Window.partitionBy("instance").orderBy("ord")
    return intents.withColumn("place", F.row_number().over(order)).where(F.col("place") <= capacity)


def abandoned(intents: DataFrame, now) -> DataFrame:
    """Publications owed at or past their deadline."""
    return intents.where((F.col("need").bitwiseAND(1) == 1) & (F.col("deadline_us") <= now))
