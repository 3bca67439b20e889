"""Preference formatting with DataFrame functions only.

A preference pair is two conversations, one chosen and one rejected. Their longest common prefix of turns is rendered
once, as the prompt; what follows on each side is rendered as a completion, with the spans that a trainer should learn
from: what the assistant says, with the mark that ends its turn. All else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE = "assistant"
#: How a turn is written: OPEN role CLOSE content END. In contents and roles OPEN is broken up, so no text can forge a turn.
OPEN, CLOSE, END, BROKEN = "<|", "|>\n", "<|end|>\n", "< |"


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit(BROKEN))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(turn["role"]), F.lit(CLOSE))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["content"]), F.lit(END))


def render(turns: Column) -> Column:
    """An array of (role, content) as one string; an empty array is the empty string."""
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x), _body(x))), "")


def common_turns(left: Column, right: Column) -> Column:
    """Number of turns that both begin with; role and content must be equal, nulls equal nulls."""
    shorter = F.least(F.size(left), F.size(right))
    same = F.zip_with(left, right, lambda a, b: F.coalesce(a["role"].eqNullSafe(b["role"]) & a["content"].eqNullSafe(b["content"]), F.lit(False)))
    first = F.array_position(F.slice(same, F.lit(1), shorter), F.lit(False))
    return F.when(first > 0, (first - 1).cast("int")).otherwise(shorter)


def learnt_spans(turns: Column) -> Column:
    """Spans `start:end`, in characters of render(turns), of the assistant's contents with END; comma-separated."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        at = state["at"] + F.length(_head(turn))
        end = at + F.length(_body(turn))
        own = F.array(F.concat(at.cast("string"), F.lit(":"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(turn["role"] == ROLE, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda state: state["spans"]), ",")


def _rest(turns: Column, k: Column) -> Column:
    return F.slice(turns, k + 1, F.greatest(F.size(turns) - k, F.lit(0)))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen and rejected (arrays of structs with role and content). Returns pair_id, prompt_turns,
    prompt, chosen, rejected, chosen_spans, rejected_spans.

    - A null side is an empty conversation; a null content is empty, a null role is written as the empty role.
    - Equal sides are all prompt, with empty completions. Sides that differ at once have an empty prompt.
    - Rows that repeat a pair_id each give a row. Other columns of pairs are not read.
    """
    kind = "array<struct<role:string,content:string>>"

    def side(name: str) -> Column:
        turns = F.transform(F.col(name), lambda x: F.struct(x["role"].cast("string").alias("role"), x["content"].cast("string").alias("content")))
        return F.coalesce(turns, F.array().cast(kind))

    found = pairs.select("pair_id", side("chosen").alias("c"), side("rejected").alias("r")).withColumn("prompt_turns", common_turns(F.col("c"), F.col("r")))
    found = found.select("pair_id", "prompt_turns", F.slice("c", F.lit(1), F.col("prompt_turns")).alias("p"), _rest(F.col("c"), F.col("prompt_turns")).alias("c"), _rest(F.col("r"), F.col("prompt_turns")).alias("r"))
    return found.select(
        "pair_id", "prompt_turns", render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"),
        learnt_spans(F.col("c")).alias("chosen_spans"), learnt_spans(F.col("r")).alias("rejected_spans"),
    )


def stale_reply_pairs(turns: DataFrame) -> DataFrame:
    """One pair for each conversation in which the assistant speaks: pair_id, chosen, rejected.

    turns: conv_id, turn, role, text. chosen is the conversation up to the assistant's last turn. In rejected that turn
    repeats what the assistant said before it, or is empty if that is the same or there was nothing.

    - Rows without conv_id belong to no conversation. Turns are ordered by turn, role and text; equal rows count once.
    - A conversation is one example and is put together in one task; no other group is.
    """
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("content")).alias("x"))
    whole = rows.groupBy("conv_id").agg(F.array_distinct(F.array_sort(F.collect_list("x"))).alias("all"))
    last = F.array_max(F.transform("all", lambda x, i: F.when(x["role"] == ROLE, i + 1).otherwise(0)))
    cut = whole.withColumn("last", last).where("last > 0")
    said = F.filter(F.slice("all", F.lit(1), F.col("last") - 1), lambda x: x["role"] == ROLE)
    own = F.coalesce(F.element_at("all", F.col("last"))["content"], F.lit(""))
    before = F.coalesce(F.when(F.size(said) > 0, F.element_at(said, F.size(said))["content"]), F.lit(""))
    cut = cut.withColumn("stale", F.when(before == own, F.lit("")).otherwise(before))
    pair = lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))
    history = F.transform(F.slice("all", F.lit(1), F.col("last") - 1), pair)
    reply = lambda content: F.array(F.struct(F.lit(ROLE).alias("role"), content.alias("content")))
    return cut.select(F.col("conv_id").alias("pair_id"), F.concat(history, reply(own)).alias("chosen"), F.concat(history, reply(F.col("stale"))).alias("rejected"))
