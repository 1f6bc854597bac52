"""Decisions: the first verdict on a trace opens [D, D + W); verdicts inside it are duplicates and don't extend it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy(verdicts: Column, window: int) -> Column:
    """Of verdicts (at_us, ord, reason) in order of time those that lie at or past the end of the window that the last
    taken one opened."""
    kind = "array<struct<at_us:bigint,ord:bigint,reason:int>>"
    start = F.struct(F.array().cast(kind).alias("taken"), F.lit(None).cast("bigint").alias("last"))

    def step(a: Column, x: Column) -> Column:
        new = a["last"].isNull() | (x["at_us"] >= a["last"] + window)
        return F.struct(F.when(new, F.concat(a["taken"], F.array(x).cast(kind))).otherwise(a["taken"]).alias("taken"), F.when(new, x["at_us"]).otherwise(a["last"]).alias("last"))

    return F.aggregate(verdicts, start, step, lambda a: a["taken"])


def decisions(verdicts: DataFrame, window: int, keys: tuple[str, ...] = ("instance", "trace_id")) -> DataFrame:
    """keys, decided_us, deadline_us, reason and ord of each decision. verdicts: keys, at_us, ord, reason (not 0).

    Verdicts of one time are reduced to the first before a trace's verdicts meet, so a hot trace's fold is as long as
    the number of its distinct times, at 20 bytes each; spans never enter it."""
    first = verdicts.groupBy(*keys, "at_us").agg(F.min(F.struct("ord", "reason")).alias("v"))
    one = F.struct("at_us", F.col("v.ord").cast("bigint").alias("ord"), F.col("v.reason").cast("int").alias("reason"))
    held = first.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("vs"))
    taken = held.select(*keys, F.explode(greedy(F.col("vs"), window)).alias("d"))
    return taken.select(*keys, F.col("d.at_us").alias("decided_us"), (F.col("d.at_us") + window).alias("deadline_us"), F.col("d.reason").alias("reason"), F.col("d.ord").alias("ord"))


def across_instances(verdicts: DataFrame, window: int, instances: int) -> DataFrame:
    """Decisions of every instance when keeps reach all others at once: instance, trace_id, decided_us, reason, origin
    (local, baseline or bus) and ord.

    A verdict that isn't a duplicate on its own instance decides there; unless it is a baseline one, every other
    instance that isn't within a window of its own decides, too. One fold per trace over (time, order, instance)."""
    first = verdicts.groupBy("trace_id", "at_us", "instance").agg(F.min(F.struct("ord", "reason")).alias("v"))
    held = first.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("at_us", F.col("v.ord").alias("ord"), "instance", F.col("v.reason").cast("int").alias("reason")))).alias("vs"))
    kind = "array<struct<instance:int,at_us:bigint,ord:bigint,reason:int,origin:string>>"
    never = -(1 << 62)
    start = F.struct(F.array_repeat(F.lit(never).cast("bigint"), instances).alias("last"), F.array().cast(kind).alias("out"))
    all_ = F.sequence(F.lit(0), F.lit(instances - 1))

    def step(a: Column, v: Column) -> Column:
        open_ = F.transform(a["last"], lambda x: v["at_us"] >= x + window)
        own = F.get(open_, v["instance"])
        sent = own & (v["reason"] != 6)
        takes = F.transform(all_, lambda i: F.when(i == v["instance"], own).otherwise(sent & F.get(open_, i)))
        last = F.transform(all_, lambda i: F.when(F.get(takes, i), v["at_us"]).otherwise(F.get(a["last"], i)))
        origin = lambda i: F.when(i != v["instance"], F.lit("bus")).when(v["reason"] == 6, F.lit("baseline")).otherwise(F.lit("local"))
        made = F.transform(F.filter(all_, lambda i: F.get(takes, i)), lambda i: F.struct(i.cast("int").alias("instance"), v["at_us"].alias("at_us"), v["ord"].alias("ord"), v["reason"].cast("int").alias("reason"), origin(i).alias("origin")))
        return F.struct(last.alias("last"), F.concat(a["out"], made.cast(kind)).alias("out"))

    return held.select("trace_id", F.explode(F.aggregate("vs", start, step, lambda a: a["out"])).alias("d")).select(
        F.col("d.instance").alias("instance"), "trace_id", F.col("d.at_us").alias("decided_us"), (F.col("d.at_us") + window).alias("deadline_us"), F.col("d.reason").alias("reason"), F.col("d.origin").alias("origin"), F.col("d.ord").alias("ord")
    )


def keeps(decided: DataFrame) -> DataFrame:
    """What is broadcast: local decisions that aren't of the baseline."""
    return decided.where("origin = 'local'").select("trace_id", "reason", "decided_us", F.col("instance").alias("origin_instance"))


def duplicates(verdicts: DataFrame, decided: DataFrame, keys: tuple[str, ...] = ("instance", "trace_id")) -> DataFrame:
    """Per key, the verdicts and the decisions among them."""
    n = verdicts.groupBy(*keys).agg(F.count("*").alias("verdicts"))
    d = decided.groupBy(*keys).agg(F.count("*").alias("decisions"))
    return n.join(d, list(keys)).select(*keys, "verdicts", "decisions", (F.col("verdicts") - F.col("decisions")).alias("duplicates"))
