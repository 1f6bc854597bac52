"""The buffer, the keeps that instances exchange, and what was kept, as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def append_spans(spans: DataFrame, path: str) -> None:
    """Into a table by instance and hour of arrival, whose partitions are what expires."""
    hour = F.floor(F.col("arrival_us") / HOUR_US).cast("bigint")
    spans.withColumn("arrival_hour", hour).write.mode("append").partitionBy("instance", "arrival_hour").parquet(path)


def read_spans(spark: SparkSession, path: str, low_us: int | None = None, high_us: int | None = None) -> DataFrame:
    """Spans that arrived in [low, high); whole partitions outside aren't read."""
    out = spark.read.parquet(path)
    if low_us is not None:
        out = out.where((F.col("arrival_hour") >= low_us // HOUR_US) & (F.col("arrival_us") >= low_us))
    if high_us is not None:
        out = out.where((F.col("arrival_hour") <= high_us // HOUR_US) & (F.col("arrival_us") < high_us))
    return out


def expired_partitions(spark: SparkSession, path: str, now_us: int, window_us: int) -> DataFrame:
    """instance and arrival_hour of partitions whose newest possible span is out of the window."""
    return spark.read.parquet(path).select("instance", "arrival_hour").distinct().where((F.col("arrival_hour") + 1) * HOUR_US <= now_us - window_us)


def publish(keeps: DataFrame, path: str, batch: int) -> None:
    """Keeps of a micro-batch; writing the same batch again replaces it, so a retry publishes once."""
    keeps.dropDuplicates(["trace_id"]).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def subscribe(spark: SparkSession, path: str, now_us: int, window_us: int, durable: bool = True) -> DataFrame:
    """Keeps that still matter: all within the window for a durable reader, none from before it came otherwise."""
    all_ = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return all_.where(F.col("decided_us") > (now_us - window_us if durable else now_us))
