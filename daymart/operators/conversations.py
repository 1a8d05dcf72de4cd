"""Conversation budgets over (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import est_tokens
from .windows import rank_top

# Context size and the parts of it held back.
MAX_TOKENS, SYSTEM_RESERVE, OUTPUT_RESERVE = 200_000, 10_000, 8_000
KEPT_TURNS = 2


def budget_of(max_tokens: int = MAX_TOKENS) -> int:
    return max_tokens - SYSTEM_RESERVE - OUTPUT_RESERVE


def truncate_conv(df: DataFrame, budget: int = budget_of(), block: int = 10_000) -> DataFrame:
    """Keep system turns, drop the oldest other turns until the rest fits.

    Adds tokens, ``kept`` and ``over_budget`` (the system turns alone do not fit, the case
    a single-conversation caller reports as an error). Turns are accumulated in blocks of
    the turn number, so one very long conversation is spread over many tasks; the block
    table carries the conversation's system total along.
    """
    is_system = F.col("role") == "system"
    rows = df.withColumn("tokens", est_tokens("text")).withColumns(
        {
            "_cost": F.when(is_system, 0).otherwise(F.col("tokens")),
            "_b": F.floor(F.col("turn") / block).cast("bigint"),
        }
    )
    blocks = rows.groupBy("conv_id", "_b").agg(
        F.sum("_cost").alias("_t"), F.sum(F.when(is_system, F.col("tokens")).otherwise(0)).alias("_s")
    )
    conv = Window.partitionBy("conv_id")
    later = conv.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "conv_id", "_b", F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_o"), F.sum("_s").over(conv).alias("_sys")
    )
    newest_first = (
        Window.partitionBy("conv_id", "_b").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    )
    used = F.sum("_cost").over(newest_first) + F.col("_o") + F.col("_sys")
    return rows.join(offsets, ["conv_id", "_b"]).select(
        *df.columns,
        "tokens",
        (is_system | (used <= budget)).alias("kept"),
        (F.col("_sys") > budget).alias("over_budget"),
    )


# The summary message in its stored form.
SUMMARY = "[历史对话已压缩] 共 %d 条消息 （用户 %d 条，助手 %d 条）。"


def compress_conv(df: DataFrame, keep: int = KEPT_TURNS) -> DataFrame:
    """(conv_id, section, turn, role, text): system turns, one summary of the older turns,
    the newest turns.

    The newest turns come from a top-n with partial limits and the summary from counts, so
    no conversation is gathered.
    """
    others = df.where("role <> 'system'")
    newest = rank_top(others, ["conv_id"], [F.desc("turn")], keep).drop("rank")

    def counts(rows: DataFrame, p: str) -> DataFrame:
        return rows.groupBy("conv_id").agg(
            F.count(F.lit(1)).alias(f"{p}n"),
            F.count_if(F.col("role") == "user").alias(f"{p}u"),
            F.count_if(F.col("role") == "assistant").alias(f"{p}a"),
        )

    gap = counts(others, "t").join(counts(newest, "k"), "conv_id").where("tn > kn")
    text = F.format_string(SUMMARY, F.col("tn") - F.col("kn"), F.col("tu") - F.col("ku"), F.col("ta") - F.col("ka"))
    summary = gap.select(
        "conv_id", F.lit("summary").alias("section"), F.lit(None).cast("bigint").alias("turn"),
        F.lit("system").alias("role"), text.alias("text"),
    )

    def section(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("conv_id", F.lit(name).alias("section"), F.col("turn").cast("bigint"), "role", "text")

    return section(df.where("role = 'system'"), "system").unionByName(summary).unionByName(section(newest, "recent"))
