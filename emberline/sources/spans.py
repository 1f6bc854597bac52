"""Tables read as spans: one row for a span, in a fixed order of arrival.

Columns: instance, batch_id, ord (unique, by arrival), arrival (TIMESTAMP_NTZ), arrival_us, trace_id (32 hexadecimal
digits), span_id, parent_span_id, name, kind, start_ns, end_ns, status_code, status_message, service, size_bytes and
attributes (array of key and VARIANT). A column attr_<key> holds an attribute that is read often, taken out of the
array; detection prefers it, so that a scan needs no more than the columns a condition names.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
T0, ELAPSED = "baggage.t0", "baggage.elapsed_ms"
BATCH = 50


def work_dir(spark: SparkSession) -> str:
    """Where tables of a run go: spark.checkpoint.dir, or a folder of our own in local mode where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="emberline-")


def micros(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {column})")


def promoted(key: str) -> str:
    return "attr_" + key.replace(".", "_")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a span; a user's events are a trace. Durations, and what a few spans carry as start of the trace
    and elapsed time, follow from value, props and event_id."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k")
    arrival = micros("ts")
    start = arrival * 1000
    duration = F.floor(F.col("value") * 1000).cast("bigint") * 1000
    elapsed = F.when(e % 13 == 0, F.lit(None)).when(e % 11 == 0, F.concat(k, F.lit("x"))).when(e % 7 == 0, F.concat(F.lit("-"), k)).otherwise(k)
    age = F.when(e % 29 == 0, F.lit(-3_600_000)).otherwise(k.cast("bigint") * 1000)
    t0 = F.when(e % 5 == 0, F.lit(None)).when(e % 31 == 0, F.lit("soon")).otherwise((F.floor(arrival / 1000).cast("bigint") - age).cast("string"))
    flat = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (e % 3).cast("int").alias("instance"),
        F.floor(e / BATCH).cast("bigint").alias("batch_id"),
        e.alias("ord"),
        F.col("ts").alias("arrival"),
        arrival.alias("arrival_us"),
        F.md5(F.col("user_id").cast("string").cast("binary")).alias("trace_id"),
        F.lpad(F.lower(F.hex(e)), 16, "0").alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.col("event_type").alias("name"),
        F.lit(2).alias("kind"),
        start.alias("start_ns"),
        F.when(e % 23 == 0, start - 1000).otherwise(start + duration).alias("end_ns"),
        F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status_code"),
        F.lit("").alias("status_message"),
        F.concat(F.lit("svc-"), (e % 4).cast("string")).alias("service"),
        (F.lit(100) + F.octet_length("props") + F.octet_length("event_type")).cast("bigint").alias("size_bytes"),
        elapsed.alias(promoted(ELAPSED)),
        t0.alias(promoted(T0)),
        k.cast("bigint").alias("k"),
    )
    attributes = F.array(
        F.struct(F.lit("k").alias("key"), F.col("k").cast("variant").alias("value")),
        F.struct(F.lit("event").alias("key"), F.col("name").cast("variant").alias("value")),
        F.struct(F.lit(ELAPSED).alias("key"), F.col(promoted(ELAPSED)).cast("variant").alias("value")),
        F.struct(F.lit(T0).alias("key"), F.col(promoted(T0)).cast("variant").alias("value")),
    )
    return flat.withColumn("attributes", attributes).drop("k")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a trace and its lines are spans, from the day of the order to that of shipment; a returned line
    is an error. Lines shipped before their order was made are spans that end before they start."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderstatus")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        (F.col("l_orderkey") % 2).cast("int").alias("instance"),
        F.md5(F.col("l_orderkey").cast("string").cast("binary")).alias("trace_id"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("o_orderdate").alias("arrival"),
        (micros("o_orderdate") * 1000).alias("start_ns"),
        (micros("l_shipdate") * 1000).alias("end_ns"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("status_code"),
        F.col("l_quantity").alias("quantity"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a trace and its turns are spans in order."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.md5(F.col("conv_id").cast("string").cast("binary")).alias("trace_id"), F.col("conv_id").alias("trace"), F.col("turn").alias("ord"), F.col("role").alias("name"), F.length("text").cast("bigint").alias("size_bytes"), "text"
    )
