"""Scalar rules on span fields, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reasons by number, and what they are called.
REASONS = {1: "error", 2: "span_latency", 3: "trace_latency", 4: "trace_age", 5: "policy", 6: "baseline"}
BITS = 56


def reason_name(reason: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in REASONS.items() for x in (k, v)]), reason.cast("int"))


def attribute(attributes: Column, key: str) -> Column:
    """The value of the first attribute of that key, or null."""
    return F.get(F.filter(attributes, lambda a: a["key"] == key), 0)["value"]


def _digits(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def read_millis(value: Column, kind: str = "variant") -> Column:
    """struct(v, ok, malformed) of a number of milliseconds: an integer, of either sign, or text of ASCII digits
    within 64 bits. What is missing isn't ok and isn't malformed either."""
    if kind == "variant":
        type_ = F.schema_of_variant(value)
        whole = type_.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | type_.rlike(r"^DECIMAL\(\d+,0\)$")
        v = F.when(whole, F.try_variant_get(value, "$", "bigint")).when(type_ == "STRING", _digits(F.try_variant_get(value, "$", "string")))
        there = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))
    else:
        v = _digits(value) if kind == "string" else value.cast("bigint")
        there = value.isNotNull()
    ok = v.isNotNull()
    return F.struct(F.coalesce(v, F.lit(0).cast("bigint")).alias("v"), ok.alias("ok"), (there & ~ok).alias("malformed"))


def threshold_millis(ns: int) -> int:
    """Whole milliseconds of a threshold; a positive one below a millisecond counts as one."""
    return max(1, ns // 1_000_000) if ns > 0 else 0


def baseline_threshold(rate: float) -> int:
    """Trace ids whose low 56 bits lie below this are sampled."""
    if math.isnan(rate) or rate <= 0:
        return 0
    return min(1 << BITS, math.floor(rate * (1 << BITS) + 0.5))


def low_bits(trace_id: Column) -> Column:
    """The low 56 bits of a trace id of 32 hexadecimal digits."""
    return F.conv(F.substring(trace_id, 19, 14), 16, 10).cast("bigint")


def in_baseline(trace_id: Column, rate: float) -> Column:
    t = baseline_threshold(rate)
    return F.lit(False) if t == 0 else low_bits(trace_id) < F.lit(t).cast("bigint")


def shard_of(trace_id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(trace_id), F.lit(shards)).cast("int")


def encode_keep(trace_id: Column, reason: Column) -> Column:
    """17 bytes: the id, then the reason."""
    return F.concat(F.unhex(trace_id), F.unhex(F.lpad(F.hex(reason.cast("int")), 2, "0")))


def decode_keep(payload: Column) -> Column:
    """struct(trace_id, reason) of 17 bytes, or of 16 without a reason (0); null for any other length."""
    n = F.octet_length(payload)
    reason = F.when(n == 17, F.conv(F.hex(F.substring(payload, 17, 1)), 16, 10).cast("tinyint")).otherwise(F.lit(0).cast("tinyint"))
    return F.when(n.isin(16, 17), F.struct(F.lower(F.hex(F.substring(payload, 1, 16))).alias("trace_id"), reason.alias("reason")))


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(x, F.lit(high) if not isinstance(high, Column) else high))


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Length of what the intervals [a, b) and [c, d) share."""
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))
