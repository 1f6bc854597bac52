"""What a run reports, as rows of instrument, label and value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.values import REASONS, in_baseline

# Names of instruments below, and these bounds.
#: Upper bounds of the histogram of ages at emission, as shares of the window.
AGE_BOUNDS = (0.1, 0.25, 0.5, 0.75, 0.9, 1.0, 1.25, 1.5)


def age_ratio(flushes: DataFrame, window: int) -> DataFrame:
    """bound (the least that isn't below the ratio; null above all) and n, over flushes (flushed_us, start_ns: that of
    the oldest span, 0 if unknown)."""
    ratio = F.greatest(F.col("flushed_us") - F.floor(F.col("start_ns") / 1000), F.lit(0)) / F.lit(float(window))
    bound = F.coalesce(*[F.when(F.col("ratio") <= b, F.lit(b)) for b in AGE_BOUNDS])
    return flushes.where("start_ns <> 0").withColumn("ratio", ratio).groupBy(bound.alias("bound")).agg(F.count("*").alias("n"))


def flushes(kept: DataFrame, keys: tuple[str, ...] = ("instance", "trace_id")) -> DataFrame:
    """One row for each decision that found spans in the buffer: when, and the start of the oldest that has one."""
    held = kept.where("not late").groupBy(*keys, "decided_us").agg(F.coalesce(F.min(F.when(F.col("start_ns") != 0, F.col("start_ns"))), F.lit(0)).alias("start_ns"), F.count("*").alias("spans"))
    return held.withColumnRenamed("decided_us", "flushed_us")


def before_first_hit(detected: DataFrame) -> DataFrame:
    """The spans that were evaluated: those of a trace's batch up to its first hit, with `leads`, whether it is the first
    of them. One shuffle on the trace's batch."""
    batch = Window.partitionBy("instance", "batch_id", "trace_id")
    hit = F.min(F.when(F.col("reason") != 0, F.col("ord"))).over(batch)
    marked = detected.withColumn("__hit", hit).withColumn("leads", F.col("ord") == F.min("ord").over(batch))
    return marked.where("__hit is null or ord <= __hit").drop("__hit")


def detected_keeps(seen: DataFrame, baseline_rate: float = 0.0) -> list[tuple[str, Column]]:
    """(reason, number) over the spans that were evaluated. A trace's batch counts for the baseline whatever else hit."""
    own = [(REASONS[r], F.count_if(F.col("reason") == r)) for r in range(1, 6)]
    return [*own, (REASONS[6], F.count_if(F.col("leads") & in_baseline(F.col("trace_id"), baseline_rate)))]


def chain_counts(detected: DataFrame, policies: list[str], baseline_rate: float = 0.0) -> DataFrame:
    """Rows of what detection counts, over evaluated spans alone, in one pass; what is counted by label and never
    happened has no row, and neither has a divergence that was never seen."""
    seen = before_first_hit(detected)
    labelled = [("detected.keeps", *x) for x in detected_keeps(seen, baseline_rate)]
    labelled += [("policy.matches", p, F.count_if(F.col("policy") == i)) for i, p in enumerate(policies)]
    labelled += [("policy.eval_errors", p, F.count_if(F.array_contains("policy_errors", i))) for i, p in enumerate(policies)]
    plain = [(f"{name}", "", F.coalesce(F.sum(column), F.lit(0))) for name, column in (("skew.clamped", "clamped"), ("baggage.malformed", "malformed"))]
    last = ("baggage.divergence_ms", "", F.max(F.when(F.col("divergence").isNotNull(), F.struct("ord", "divergence")))["divergence"])
    all_ = [*labelled, *plain, last]
    counted = seen.agg(*[c.cast("bigint").alias(f"c{i}") for i, (_, _, c) in enumerate(all_)])
    rows = F.array(*[F.struct(F.lit(name).alias("instrument"), F.lit(label).alias("label"), F.col(f"c{i}").alias("value")) for i, (name, label, _) in enumerate(all_)])
    return counted.select(F.explode(rows).alias("r")).select("r.*").where("value is not null and (label = '' or value > 0)")


def one(rows: DataFrame, instrument: str, value: Column) -> DataFrame:
    """A row of an instrument without label."""
    return rows.agg(value.cast("bigint").alias("value")).select(F.lit(instrument).alias("instrument"), F.lit("").alias("label"), "value")


def decision_counts(verdicts: DataFrame, decided: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of what decisions and emission count; decided has origin."""
    n = one(verdicts, "duplicate.keeps", F.count("*")).select(F.col("value").alias("v"))
    own = one(decided.where("origin <> 'bus'"), "duplicate.keeps", F.count("*"))
    parts = [
        own.crossJoin(n).select("instrument", "label", (F.col("v") - F.col("value")).alias("value")),  # one row each
        one(decided, "kept.local", F.count_if(F.col("origin") != "bus")),
        one(decided, "kept.bus", F.count_if(F.col("origin") == "bus")),
        one(decided, "published.keeps", F.count_if(F.col("origin") == "local")),
        one(kept, "flushed.spans", F.count("*")),
    ]
    return reduce(DataFrame.unionByName, parts)


def buffer_gauges(held: DataFrame, decided: DataFrame, now, window: int) -> DataFrame:
    """Rows of what the buffer and the decided set hold at a time."""
    parts = [
        one(held.where(F.col("t_max_us") < now - window), "expired.bytes", F.coalesce(F.sum("bytes"), F.lit(0))),
        one(held.where(F.col("t_max_us") >= now - window), "disk.bytes", F.coalesce(F.sum("bytes"), F.lit(0))),
        one(decided.where((F.col("decided_us") <= now) & (F.col("deadline_us") > now)), "decided.entries", F.count("*")),
    ]
    return reduce(DataFrame.unionByName, parts)
