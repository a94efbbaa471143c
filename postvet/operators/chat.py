"""Chat logs: blank messages, replies, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postvet.functions.ordered import with_next
from postvet.functions.text import browser_trim

# The two senders of a chat.
USER, BOT = "user", "bot"


def chat_clean(chat: DataFrame) -> DataFrame:
    """Drop messages that are blank once trimmed; texts stay untrimmed."""
    return chat.filter(F.length(browser_trim(F.col("text"))) > 0)


def chat_turn_pairs(chat: DataFrame) -> DataFrame:
    """Each user message with the reply right after it, null if there is none."""
    paired = with_next(
        chat.select("conv_id", "turn", "role", "text"), ["conv_id"], "turn", ["role", "text"]
    )
    return paired.filter(F.col("role") == USER).select(
        "conv_id", "turn", "text",
        F.when(F.col("next_role") == BOT, F.col("next_text")).alias("reply"),
    )


def chat_summary(chat: DataFrame, roles: tuple[str, ...] = (USER, BOT, "system")) -> DataFrame:
    """Messages per conversation and sender, and the share of unanswered ones.

    Senders that are not named, and missing ones, count as `other_messages`.
    """
    # Only roles are needed here, so texts stay where they are.
    marked = with_next(chat.select("conv_id", "turn", "role"), ["conv_id"], "turn", ["role"])
    unanswered = (F.col("role") == USER) & ~F.coalesce(F.col("next_role") == BOT, F.lit(False))
    known = F.when(F.col("role").isin(*roles), F.col("role")).otherwise("other")
    counts = (
        marked.withColumn("_sender", known).groupBy("conv_id")
        .pivot("_sender", [*roles, "other"])
        .agg(F.count(F.lit(1)).alias("messages"), F.count_if(unanswered).alias("unanswered"))
        .fillna(0)
    )
    return counts.select(
        "conv_id",
        *[F.col(f"{r}_messages") for r in (*roles, "other")],
        F.round(F.try_divide(f"{USER}_unanswered", f"{USER}_messages"), 4).alias("unanswered_share"),
    )
