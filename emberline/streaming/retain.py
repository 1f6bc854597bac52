"""Decisions and the retroactive join over streams.

Event time is arrival. A stamp ahead of the clock is set to the clock, so that one bad row can't carry the
watermark away. Decisions are made by a stateful operator that holds, per trace, when the last was made; a
verdict at or past its end opens the next, and what is held goes when the watermark has passed that end. (Dropping duplicates within a watermark isn't the same: state
would stay until the watermark, itself late, has passed.) Decisions then meet spans in a stream-stream join
whose interval bounds the state on both sides to two windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.session import ship

MICRO = 1_000_000
DECISION = T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("decided_us", T.LongType()), T.StructField("reason", T.IntegerType()), T.StructField("decided_at", T.TimestampType())])
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


class Decider(StatefulProcessor):
    """Verdicts (trace_id, at_us, ord, reason, arrival) in, decisions out."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("at_us", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.last.get()
        last = held[0] if held else None
        for row in sorted(rows, key=lambda r: (r.at_us, r.ord)):
            if last is None or row.at_us >= last + self.window:
                last = row.at_us
                yield Row(trace_id=key[0], decided_us=last, reason=int(row.reason), decided_at=row.arrival)
        if last is not None and (not held or last != held[0]):
            self.last.update((last,))
            for timer in [*self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-(last + self.window) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """No verdict before the end of the window can come any more, and any later one decides anew."""
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """State in RocksDB, which stateful processors need, and this package where they run."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def clamped(spans: DataFrame) -> DataFrame:
    """spans whose arrival (and arrival_us) isn't ahead of the clock, and `skewed`, whether it was."""
    now = F.current_timestamp()
    held = spans.withColumn("skewed", F.col("arrival") > now).withColumn("arrival", F.least("arrival", now))
    return held.withColumn("arrival_us", F.unix_micros("arrival"))


def decisions(verdicts: DataFrame, window: int, delay: str) -> DataFrame:
    """A stream of decisions with event time decided_at; verdicts: trace_id, arrival, at_us, ord, reason."""
    watched = verdicts.withWatermark("arrival", delay)
    return watched.groupBy("trace_id").transformWithState(Decider(window), DECISION, "Append", "EventTime", eventTimeColumnName="decided_at")


def retained(spans: DataFrame, verdicts: DataFrame, window: int, delay: str) -> DataFrame:
    """Spans (trace_id, arrival, arrival_us, ...) of decided traces that arrived in [D - W, D + W)."""
    d = decisions(verdicts, window, delay).select(F.col("trace_id").alias("d_trace"), "decided_us", F.col("reason").alias("keep_reason"), "decided_at")
    s = spans.withWatermark("arrival", delay)
    width = F.expr(f"INTERVAL '{window // MICRO}' SECOND") if window % MICRO == 0 else F.expr(f"make_dt_interval(0, 0, 0, {window / MICRO})")
    near = (F.col("trace_id") == F.col("d_trace")) & (F.col("arrival") >= F.col("decided_at") - width) & (F.col("arrival") < F.col("decided_at") + width)
    return s.join(d, near, "inner").drop("d_trace", "decided_at").withColumn("late", F.col("arrival_us") >= F.col("decided_us"))


def events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int | None = None) -> DataFrame:
    """The event files of a folder as a stream of spans: trace_id, ord, arrival, arrival_us, name, status_code, skewed."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    spans = reader.parquet(folder).select(
        F.md5(F.col("user_id").cast("string").cast("binary")).alias("trace_id"), F.col("event_id").alias("ord"), F.timestamp_micros(us).alias("arrival"), us.alias("arrival_us"), F.col("event_type").alias("name"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status_code")
    )
    return clamped(spans)


def errors(spans: DataFrame) -> DataFrame:
    """Verdicts of a stream's error spans."""
    return spans.where("status_code = 2").select("trace_id", "arrival", F.col("arrival_us").alias("at_us"), "ord", F.lit(1).alias("reason"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends to a Parquet table all that a stream yields from what is there now; a restart goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()


def each_batch(stream: DataFrame, publish: Callable[[DataFrame, int], None], emit: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that publishes a batch's decisions before it emits the batch's spans. If publishing fails, the
    batch fails and is run again, so nothing is emitted that wasn't published; both must be idempotent by batch."""

    def both(batch: DataFrame, number: int) -> None:
        publish(batch, number)
        emit(batch, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(both).start()
