"""Deterministic spans for load and tests: ids from splitmix64, classes by leading index, spans dealt in turn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import ship


def splitmix64(state: np.ndarray) -> np.ndarray:
    """The published mixer, of states that have been advanced by its increment."""
    z = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def splitmix_sequence(seed: int, first: int, n: int) -> np.ndarray:
    """Outputs first to first + n - 1 of the generator that starts from seed."""
    steps = np.arange(first + 1, first + n + 1, dtype=np.uint64)
    return splitmix64(np.uint64(seed) + steps * np.uint64(0x9E3779B97F4A7C15))


def class_of(index, errors: int, slow: int, late: int):
    """error, slow, trace_latency or healthy by the trace's index."""
    return F.when(index < errors, "error").when(index < errors + slow, "slow").when(index < errors + slow + late, "trace_latency").otherwise("healthy")


def percent_bounds(n: int, *percents: float) -> list[int]:
    """How many of n fall into each class, by rounding the running percentage."""
    out, total, last = [], 0.0, 0
    for p in percents:
        total += p
        at = int(n * total / 100 + 0.5)
        out.append(at - last)
        last = at
    return out


def generate(spark: SparkSession, traces: int, spans: int, endpoints: int, errors: int = 0, slow: int = 0, late: int = 0, seed: int = 0, base_ns: int = 1_700_000_000_000_000_000) -> DataFrame:
    """trace, span, instance, trace_id, class, status_code, start_ns, end_ns, attr_baggage_elapsed_ms and arrival_us
    of traces * spans spans; span j goes to endpoint j % endpoints, and what marks a trace is on its span 0."""

    ship(spark)

    def ids(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in column:
            i = x.to_numpy().astype(np.uint64)
            a, b = (splitmix64(np.uint64(seed) + (2 * i + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) for k in (1, 2))
            yield pd.Series([f"{p:016x}{q:016x}" for p, q in zip(a.tolist(), b.tolist())])

    trace_id = F.pandas_udf(ids, "string")
    t = spark.range(traces).select(F.col("id").alias("trace"), class_of(F.col("id"), errors, slow, late).alias("class")).withColumn("trace_id", trace_id("trace"))
    s = t.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
    first = F.col("span") == 0
    start = F.lit(base_ns) + F.col("trace") * 1_000_000 + F.col("span") * 1000
    return s.select(
        "trace", "span", (F.col("span") % endpoints).cast("int").alias("instance"), "trace_id", "class",
        F.when(first & (F.col("class") == "error"), 2).otherwise(1).alias("status_code"),
        start.alias("start_ns"),
        (start + F.when(first & (F.col("class") == "slow"), 2_000_000_000).otherwise(1_000_000)).alias("end_ns"),
        F.when(first & (F.col("class") == "trace_latency"), F.lit(10_000)).cast("bigint").alias("attr_baggage_elapsed_ms"),
        F.floor(start / 1000).cast("bigint").alias("arrival_us"),
    )
