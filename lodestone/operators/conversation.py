"""Conversation budgets and compression, for all conversations at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import estimate_tokens

#: The heading of a summary, and the characters it keeps without a model.
HEADING, KEPT_CHARS = "【历史对话摘要】", 300


def token_totals(turns: DataFrame) -> DataFrame:
    """conv_id, messages, tokens."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum(estimate_tokens("text")), F.lit(0)).alias("tokens"))


def naive_summary(history: Column) -> Column:
    return F.concat(F.lit(HEADING), F.left(history, F.lit(KEPT_CHARS)), F.when(F.length(history) > KEPT_CHARS, "...").otherwise(""))


def compress(turns: DataFrame, max_tokens: int = 2000, keep_recent: int = 4, summary: Callable[[Column], Column] = naive_summary) -> DataFrame:
    """conv_id, position from 0, role, text.

    A conversation within max_tokens, or with at most keep_recent messages, or with nothing before its last keep_recent
    messages other than system ones, is unchanged. Otherwise: system messages, one summary (as system) of the rest, and
    the last keep_recent. keep_recent 0 leaves all unchanged.
    """
    per = Window.partitionBy("conv_id")
    system = F.when(F.col("role") == "system", 1).otherwise(0)
    x = turns.select("conv_id", "turn", "role", "text").withColumns({
        "total": F.sum(estimate_tokens("text")).over(per), "n": F.count(F.lit(1)).over(per), "system": F.coalesce(system, F.lit(0)),
    })
    back = Window.partitionBy("conv_id", "system").orderBy(F.desc("turn"))
    x = x.withColumn("back", F.row_number().over(back))
    old = (F.col("system") == 0) & (F.col("back") > keep_recent)
    some = F.max(F.when(old, 1).otherwise(0)).over(per)
    x = x.withColumn("shrink", (F.col("total") > max_tokens) & (F.col("n") > keep_recent) & (some == 1) & F.lit(keep_recent > 0)).withColumn("old", old)
    line = F.concat(F.coalesce("role", F.lit("None")), F.lit(": "), F.coalesce("text", F.lit("")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda r: r["line"]), "\n")
    made = x.where("shrink AND old").groupBy("conv_id").agg(lines.alias("history")).select("conv_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("turn"), F.lit("system").alias("role"), summary(F.col("history")).alias("text"))
    part = F.when(F.col("shrink") & (F.col("system") == 1), 0).otherwise(2)
    kept = x.where("NOT (shrink AND old)").select("conv_id", part.alias("part"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = Window.partitionBy("conv_id").orderBy("part", "turn")
    return kept.unionByName(made).select("conv_id", (F.row_number().over(order) - 1).alias("position"), "role", "text")


def append_turns(turns: DataFrame, more: DataFrame) -> DataFrame:
    """turns with more (conv_id, n from 0, role, text) behind each conversation's last turn."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    placed = more.join(last, "conv_id", "left").select("conv_id", (F.coalesce("last", F.lit(-1)) + 1 + F.col("n")).alias("turn"), "role", "text")
    return turns.select("conv_id", "turn", "role", "text").unionByName(placed)


def compress_messages(messages: list[dict], max_tokens: int, keep_recent: int, summarizer: Callable[[str], str] | None = None) -> list[dict]:
    """The same for the one conversation of a request, on the driver. A summariser that fails is replaced by the naive one."""
    sizes = [_estimate(m.get("content") or "") for m in messages]
    speech = [m for m in messages if m.get("role") != "system"]
    early = speech[: len(speech) - keep_recent] if keep_recent and len(speech) > keep_recent else []
    if sum(sizes) <= max_tokens or len(messages) <= keep_recent or not early:
        return messages
    history = "\n".join(f"{m.get('role')}: {m.get('content', '')}" for m in early)
    try:
        text = summarizer(history) if summarizer else _naive(history)
    except Exception:  # noqa: BLE001  the conversation must go on
        text = _naive(history)
    return [m for m in messages if m.get("role") == "system"] + [{"role": "system", "content": text}] + speech[-keep_recent:]


def _naive(history: str) -> str:
    return HEADING + history[:KEPT_CHARS] + ("..." if len(history) > KEPT_CHARS else "")


def _estimate(text: str) -> int:
    han = sum("一" <= c <= "鿿" for c in text)
    return han + (len(text) - han) // 4 + 1 if text else 0
