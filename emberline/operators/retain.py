"""The retroactive join: every span of a decided trace that arrived in [D - W, D + W)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cell(at, window: int):
    return F.floor(at / window).cast("bigint")


def _near(decided: DataFrame, window: int, keys: tuple[str, ...], before=0) -> DataFrame:
    """Decisions, dealt to the cells of one window that [D - W - before, D + W) meets."""
    at = F.col("decided_us")
    return decided.select(*keys, "decided_us", F.col("reason").alias("keep_reason"), F.explode(F.sequence(_cell(at - window - before, window), _cell(at + window - 1, window))).alias("__cell"))


def _inside(window: int):
    at = F.col("decided_us")
    return (F.col("arrival_us") >= at - window) & (F.col("arrival_us") < at + window)


def retained(spans: DataFrame, decided: DataFrame, window: int, keys: tuple[str, ...] = ("instance", "trace_id")) -> DataFrame:
    """Columns of spans, decided_us, keep_reason and late (arrived at or after the decision). A span inside two
    decisions' intervals is emitted twice.

    Time is cut into cells of one window, and a decision is dealt to the at most three that its interval meets: spans
    of one hot trace then meet only decisions nearby, on as many tasks as there are cells. Whether decisions are
    broadcast is left to their size."""
    joined = spans.withColumn("__cell", _cell(F.col("arrival_us"), window)).join(_near(decided, window, keys), [*keys, "__cell"])
    return joined.where(_inside(window)).drop("__cell").withColumn("late", F.col("arrival_us") >= F.col("decided_us"))


def expired(spans: DataFrame, decided: DataFrame, window: int, keys: tuple[str, ...] = ("instance", "trace_id")) -> DataFrame:
    """Spans that no decision takes: one anti-join by trace and cell."""
    near = _near(decided, window, keys).select(*[F.col(k).alias(f"__{k}") for k in keys], "decided_us", F.col("__cell").alias("__near"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    held = spans.withColumn("__cell", _cell(F.col("arrival_us"), window))
    return held.join(near, [*same, F.col("__cell") == F.col("__near"), _inside(window)], "left_anti").drop("__cell")


def retained_by_segment(spans: DataFrame, decided: DataFrame, segments: DataFrame, window: int, keys: tuple[str, ...] = ("instance", "trace_id")) -> DataFrame:
    """Like retained, but what lay in the buffer is judged by its whole segment: a span counts as long as the newest
    of its segment is within the window. spans and segments have shard and gen.

    Decisions are dealt to cells as in `retained`, back by the longest time that a segment of the instance spans."""
    held = spans.join(segments.select("instance", "shard", "gen", F.col("t_max_us")), ["instance", "shard", "gen"])
    longest = segments.groupBy("instance").agg(F.max(F.col("t_max_us") - F.col("t_min_us")).alias("__longest"))  # a row an instance
    near = _near(decided.join(longest, "instance"), window, keys, F.col("__longest"))
    joined = held.withColumn("__cell", _cell(F.col("arrival_us"), window)).join(near, [*keys, "__cell"]).drop("__cell")
    early = (F.col("arrival_us") < F.col("decided_us")) & (F.col("t_max_us") >= F.col("decided_us") - window)
    late = (F.col("arrival_us") >= F.col("decided_us")) & (F.col("arrival_us") < F.col("decided_us") + window)
    return joined.where(early | late).withColumn("late", late)
