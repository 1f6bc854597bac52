"""The detection chain: error, span latency, trace latency, trace age, policies in order; the first hit counts."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import rules, values
from emberline.sources.spans import ELAPSED, T0, promoted


@dataclasses.dataclass(frozen=True)
class Chain:
    """Conditions of the chain; a threshold of 0 leaves its condition out. Latencies are nanoseconds."""

    on_error: bool = True
    span_latency: int = 0
    trace_latency: int = 0
    trace_age: int = 0
    policies: Sequence[tuple[str, str]] = ()
    t0_attribute: str = T0
    elapsed_attribute: str = ELAPSED
    baseline_rate: float = 0.0

    @classmethod
    def of(cls, config) -> Chain:
        return cls(config.keep_on_error, config.span_latency_threshold, config.trace_latency_threshold, config.trace_age_threshold, tuple((p.name, p.condition) for p in config.policies), config.t0_attribute, config.elapsed_ms_attribute, config.baseline_rate)

    @property
    def enabled(self) -> bool:
        return bool(self.on_error or self.span_latency or self.trace_latency or self.trace_age or self.policies or self.baseline_rate > 0)


def _kind(spans: DataFrame, column: str) -> str:
    return {"string": "string", "bigint": "int", "int": "int", "double": "float", "float": "float", "boolean": "bool", "variant": "any"}[dict(spans.dtypes)[column]]


def millis(spans: DataFrame, key: str) -> Column:
    """struct(v, ok, malformed) of the attribute."""
    column = promoted(key)
    if column in spans.columns:
        kind = dict(spans.dtypes)[column]
        return values.read_millis(F.col(column), "variant" if kind == "variant" else "string" if kind == "string" else "int")
    if "attributes" not in spans.columns:
        return values.read_millis(F.lit(None).cast("string"), "string")
    return values.read_millis(values.attribute(F.col("attributes"), key))


def lookup(spans: DataFrame) -> rules.Lookup:
    """How conditions find fields and attributes among the columns of spans; what isn't there is missing."""

    def find(place: str, key: str) -> tuple[Column, str]:
        if place == "field":
            column, kind = rules.FIELDS[key]
            return (F.col(column), kind) if column in spans.columns else (F.lit(None).cast("string" if kind == "string" else "bigint"), kind)
        if place == "span" and promoted(key) in spans.columns:
            return F.col(promoted(key)), _kind(spans, promoted(key))
        array = rules.ATTRIBUTES[place]
        return (values.attribute(F.col(array), key), "any") if array in spans.columns else (F.lit(None).cast("variant"), "any")

    return find


def detect(spans: DataFrame, chain: Chain) -> DataFrame:
    """spans with reason (0 none), policy (index of the one that hit, from 0), policy_errors (indexes of those that
    failed before), clamped (how many values were out of range), malformed (1 if an attribute is) and divergence (age minus
    elapsed time, where both are known). A condition that is left out isn't computed, nor is what it reads."""
    zero = F.lit(0)
    out = spans
    tests: list[tuple[Column, int]] = []
    clamps: list[Column] = []
    if chain.on_error:
        tests.append((F.col("status_code") == 2, 1))
    reached: list[Column] = []  # earlier tests that hit, after which nothing more is looked at

    def before() -> Column:
        return ~F.coalesce(F.greatest(*[c.cast("int") for c in reached]) if len(reached) > 1 else reached[0].cast("int"), zero).cast("boolean") if reached else F.lit(True)

    reached += [F.coalesce(c, F.lit(False)) for c, _ in tests]
    if chain.span_latency:
        ordered = F.col("end_ns") >= F.col("start_ns")
        tests.append((ordered & (F.try_subtract("end_ns", "start_ns") > chain.span_latency), 2))
        clamps.append(before() & ~ordered)
        reached.append(F.coalesce(tests[-1][0], F.lit(False)))
    both = bool(chain.trace_latency or chain.trace_age)
    if both:
        now = F.floor(F.col("arrival_us") / 1000).cast("bigint")
        out = out.withColumn("__elapsed", millis(spans, chain.elapsed_attribute)).withColumn("__t0", millis(spans, chain.t0_attribute))
        out = out.withColumn("__age", F.when(F.col("__t0.ok"), F.try_subtract(now, F.col("__t0.v")))).withColumn("__spent", F.when(F.col("__elapsed.ok"), F.col("__elapsed.v")))
        looked = before()
        age, spent = F.greatest(F.col("__age"), zero), F.greatest(F.col("__spent"), zero)
        clamps += [looked & (F.col("__age") < 0), looked & (F.col("__spent") < 0)]
        malformed = F.when(looked, (F.col("__elapsed.malformed") | F.col("__t0.malformed")).cast("int")).otherwise(0)
        divergence = F.when(looked & F.col("__t0.ok") & F.col("__elapsed.ok"), age - spent)
        if chain.trace_latency:
            tests.append((F.col("__spent").isNotNull() & (spent > values.threshold_millis(chain.trace_latency)), 3))
            reached.append(F.coalesce(tests[-1][0], F.lit(False)))
        if chain.trace_age:
            tests.append((F.col("__age").isNotNull() & (age > values.threshold_millis(chain.trace_age)), 4))
            reached.append(F.coalesce(tests[-1][0], F.lit(False)))
    hit = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in tests]) if tests else F.lit(None).cast("int")
    compiled = [rules.compile_condition(text).columns(lookup(spans)) for _, text in chain.policies]
    first = F.coalesce(*[F.when(m, F.lit(i)) for i, (m, _) in enumerate(compiled)]) if compiled else F.lit(None).cast("int")
    out = out.withColumn("__hit", hit).withColumn("policy", F.when(F.col("__hit").isNull(), first).cast("int"))
    failed = F.array(*[F.when(e & (F.coalesce(F.col("policy"), F.lit(len(compiled))) > i), F.lit(i)) for i, (_, e) in enumerate(compiled)]) if compiled else F.array().cast("array<int>")
    out = (
        out.withColumn("reason", F.coalesce("__hit", F.when(F.col("policy").isNotNull(), F.lit(5)), zero).cast("tinyint"))
        .withColumn("policy_errors", F.when(F.col("__hit").isNull(), F.array_compact(failed)).otherwise(F.array().cast("array<int>")))
        .withColumn("clamped", sum((F.coalesce(c, F.lit(False)).cast("int") for c in clamps), zero))
        .withColumn("malformed", malformed if both else zero)
        .withColumn("divergence", divergence if both else F.lit(None).cast("bigint"))
    )
    return out.drop("__hit", "__elapsed", "__t0", "__age", "__spent")


def verdicts(detected: DataFrame, rate: float = 0.0) -> DataFrame:
    """One row for each trace of a batch on an instance: reason (the first that isn't 0 in order of arrival, else 6 if
    the trace is in the baseline, else 0), base, policy, at and ord of the first hit, and the counts of what was looked
    at until then: spans after the first hit aren't evaluated."""
    keys = ["instance", "batch_id", "trace_id"]
    hit = F.col("reason") != 0
    grouped = detected.groupBy(*keys).agg(
        F.count("*").alias("spans"),
        F.min("ord").alias("first_ord"),
        F.min("arrival_us").alias("first_at"),
        F.min(F.when(hit, F.struct("ord", "arrival_us", "reason", "policy"))).alias("hit"),
    )
    base = values.in_baseline(F.col("trace_id"), rate)
    return grouped.select(
        *keys,
        F.coalesce("hit.reason", F.when(base, F.lit(6)), F.lit(0)).cast("int").alias("reason"),
        base.alias("base"),
        F.col("hit.policy").alias("policy"),
        F.coalesce("hit.arrival_us", "first_at").alias("at_us"),
        F.coalesce("hit.ord", "first_ord").alias("ord"),
        "spans",
    )
