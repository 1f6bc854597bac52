"""Preference pairs as one prompt and two masked completions.

The turns that a chosen and a rejected conversation have in common at their beginning are rendered once,
as the prompt; what follows on either side becomes its completion. A completion's mask lists, turn by
turn, the lengths of its parts and whether they count in the loss: `length:0` for a turn's header and for
what others say, `length:1` for what the assistant says, with its end mark.

Everything is DataFrame expressions; each pair is one row, made whole by a single shuffle on its key.

Defined results: a null role or text is rendered as empty. Equal conversations have an empty completion on
either side; so has a conversation that is the beginning of the other, on its side. A null or empty array
has no turns. Turns sort by number, then role and text, nulls first; turns of a null key are one
conversation; an empty table gives no rows. Added columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import bind, fresh

# The marks of the template.
START, AFTER_ROLE, STOP = "<|im_start|>", "\n", "<|im_end|>\n"
ASSISTANT = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def _header(t: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(t["role"], F.lit("")), F.lit(AFTER_ROLE))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(STOP))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def mask(turns: Column) -> Column:
    loss = lambda t: F.when(t["role"] == ASSISTANT, ":1").otherwise(":0")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.length(_header(t)).cast("string"), F.lit(":0,"), F.length(_body(t)).cast("string"), loss(t))), ",")


def common_turns(a: Column, b: Column) -> Column:
    """How many turns a and b have in common at their beginning."""
    n = F.least(F.size(a), F.size(b))
    same = lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~same(F.get(a, i), F.get(b, i)))
    return F.when(n > 0, F.coalesce(F.array_min(differ), n)).otherwise(0)


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs, whose columns chosen and rejected (arrays of role and text) become the rendered completions, with
    n_prompt_turns, prompt, chosen_mask and rejected_mask."""
    none = F.array().cast(TURNS)
    plain = lambda t: F.struct(*[F.coalesce(t[k], F.lit("")).alias(k) for k in ("role", "text")])
    both = F.struct(*[F.transform(F.coalesce(F.col(c).cast(TURNS), none), plain).alias(c) for c in ("chosen", "rejected")])

    def made(p: Column) -> Column:
        def of(n: Column) -> Column:
            rest = {c: F.slice(p[c], n + 1, F.greatest(F.size(p[c]) - n, F.lit(0))) for c in ("chosen", "rejected")}
            return F.struct(
                n.alias("n_prompt_turns"),
                render(F.slice(p["chosen"], F.lit(1), n)).alias("prompt"),
                *[render(rest[c]).alias(c) for c in rest],
                *[mask(rest[c]).alias(f"{c}_mask") for c in rest],
            )

        return bind(common_turns(p["chosen"], p["rejected"]), of)

    names = ["n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"]
    held = fresh(pairs, "made")
    out = pairs.withColumn(held, bind(both, made))
    return out.select(*[F.col(f"`{c}`") for c in pairs.columns if c not in names], *[F.col(f"{held}.{c}").alias(c) for c in names])


def gathered(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and turns (array of role and text, in order) of a table with a row for each turn."""
    held = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy(key).agg(held.alias("turns")).select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def with_earlier_reply(conversations: DataFrame) -> DataFrame:
    """conversations (turns) as pairs: rejected has, in the place of the last reply of the assistant, the one
    before it, or nothing."""

    def swapped(turns: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: F.get(turns, i)["role"] == ASSISTANT)

        def of(at: Column) -> Column:
            last, before = F.get(at, F.size(at) - 1), F.get(at, F.size(at) - 2)
            earlier = F.coalesce(F.get(turns, before)["text"], F.lit(""))
            return F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), F.when(i == last, earlier).otherwise(t["text"]).alias("text")))

        return bind(places, of)

    return conversations.withColumn("rejected", bind(F.col("turns"), lambda t: F.when(F.size(t) > 0, swapped(t)).otherwise(t))).withColumnRenamed("turns", "chosen")
