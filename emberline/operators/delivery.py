"""What is offered, published and emitted, and what becomes of it where that fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.metrics import one

#: Keeps that are acknowledged together.
CHUNK = 64
#: Bits of work that is owed.
PUBLISH, FLUSH = 1, 2


def offered(fragments: DataFrame, capacity: int, tick: str = "batch_id") -> DataFrame:
    """fragments (instance, shard, tick, ord) with admitted: a shard's queue takes so many in a tick, in order of
    arrival, and refuses the rest. What is ordered together is one tick of one shard."""
    order = Window.partitionBy("instance", "shard", tick).orderBy("ord")
    return fragments.withColumn("admitted", F.row_number().over(order) <= capacity)


def accounting(fragments: DataFrame) -> DataFrame:
    """For each instance and shard what was offered, buffered and shed; every fragment is one of the latter two."""
    return fragments.groupBy("instance", "shard").agg(F.count("*").alias("offered"), F.count_if("admitted").alias("buffered"), F.count_if(~F.col("admitted")).alias("shed"))


def chunked(keeps: DataFrame, stretch_us: int) -> DataFrame:
    """keeps (trace_id, decided_us, origin_instance) with chunk: an instance's keeps of a stretch of time go out in
    chunks of CHUNK, oldest first."""
    order = Window.partitionBy("origin_instance", F.floor(F.col("decided_us") / stretch_us)).orderBy("decided_us", "trace_id")
    return keeps.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / CHUNK).cast("int"))


def published(keeps: DataFrame, failed: DataFrame, window: int, keys: tuple[str, ...] = ("trace_id", "decided_us")) -> DataFrame:
    """keeps with outcome and deadline_us: those in the failed set are parked again until a window after the decision, the
    others are published (0). failed: keys of keeps, repeated or not; others than those of keeps have no effect."""
    gone = failed.select(*keys).distinct().withColumn("__failed", F.lit(True))
    out = keeps.join(gone, list(keys), "left")
    lost = F.coalesce("__failed", F.lit(False))
    return out.withColumn("outcome", F.when(lost, "parked").otherwise("published")).withColumn("deadline_us", F.when(lost, F.col("decided_us") + window).otherwise(0)).drop("__failed")


def settled(flushes: DataFrame, error: Column) -> DataFrame:
    """flushes with need and outcome. error: null where the next consumer took them, `retryable` or `permanent`. What can
    be tried again stays owed, its flush bit alone; what can't is dropped and counted."""
    outcome = F.when(error.isNull(), "delivered").when(error == "retryable", "retry").otherwise("dropped")
    return flushes.withColumn("outcome", outcome).withColumn("need", F.when(F.col("outcome") == "retry", FLUSH).otherwise(0))


def delivery_counts(fragments: DataFrame, keeps: DataFrame, flushes: DataFrame, payloads: DataFrame) -> DataFrame:
    """Rows of what delivery counts: offered fragments, published keeps, settled flushes, and payloads (keep: decoded,
    null where it isn't one)."""
    parts = [
        one(fragments, "shed.queue_full", F.count_if(~F.col("admitted"))),
        one(keeps, "publish.errors", F.count_if(F.col("outcome") == "parked")),
        one(flushes, "flush.retries", F.count_if(F.col("outcome") == "retry")),
        one(flushes, "flush.errors", F.count_if(F.col("outcome") == "dropped")),
        one(flushes, "pending.flushes", F.count_if(F.col("need").bitwiseAND(FLUSH) == FLUSH)),
        one(payloads, "bus.malformed", F.count_if(F.col("keep").isNull())),
    ]
    return reduce(DataFrame.unionByName, parts)


def of_trace(spans: DataFrame, *trace_ids: str) -> DataFrame:
    """The spans of a few traces; which, reaches the scan."""
    return spans.where(F.col("trace_id").isin(*trace_ids))


def dead_traces(spans: DataFrame, segments: DataFrame, now, window: int) -> DataFrame:
    """instance, shard and trace_id of traces whose newest segment has expired, so nothing of them is left."""
    newest = spans.groupBy("instance", "shard", "trace_id").agg(F.max("gen").alias("gen"))
    gone = segments.where(F.col("t_max_us") < now - window).select("instance", "shard", "gen")
    return newest.join(gone, ["instance", "shard", "gen"], "left_semi").select("instance", "shard", "trace_id", F.col("gen").alias("last_gen"))


def kept_ids(kept: DataFrame, most: int) -> DataFrame:
    """The least `most` trace ids, as a run's summary lists them."""
    return kept.select("trace_id").distinct().orderBy("trace_id").limit(most)


def saturated(value: Column, kind: str = "int") -> Column:
    """value in a narrower type: its least or greatest number where it doesn't fit."""
    bits = {"tinyint": 7, "smallint": 15, "int": 31}[kind]
    return F.greatest(F.lit(-(1 << bits)), F.least(value, F.lit((1 << bits) - 1))).cast(kind)


def pace_us(sent: Column, per_second: float) -> Column:
    """When a load at that rate is due, in microseconds from its start, after so many spans."""
    return F.floor(sent * (1_000_000 / per_second)).cast("bigint")
