"""Profiles, usage figures, quota and record keeping."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postvet.functions.ordered import positions
from postvet.functions.text import browser_trim, masked

SCAN, VERIFIED = "scan", "verified"


def profile_skills(profile_ops: DataFrame) -> DataFrame:
    """Skill list of each user after replaying all adds and removes.

    Input: (user_id, seq, op, skill), seq unique per user. An add of a present
    skill changes nothing, so a skill stands where its first add after its last
    remove stood. Adds are trimmed; a remove takes the exact text.
    """
    ops = profile_ops.select(
        "user_id", "seq", "op",
        F.when(F.col("op") == "add", browser_trim(F.col("skill"))).otherwise(F.col("skill")).alias("skill"),
    )
    removed = (
        ops.filter("op = 'remove'").groupBy("user_id", "skill").agg(F.max("seq").alias("_gone"))
    )
    present = (
        ops.filter("op = 'add' AND skill != ''")
        .join(removed, ["user_id", "skill"], "left")
        .filter(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone")))
        .groupBy("user_id", "skill")
        .agg(F.min("seq").alias("seq"))
    )
    return positions(present, ["user_id"], "seq").select("user_id", "pos", "skill")


def profile_completion(profiles: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Percent of the fields that are neither null nor empty."""
    filled = [
        F.when(F.nullif(F.col(f).cast("string"), F.lit("")).isNotNull(), 1).otherwise(0)
        for f in fields
    ]
    total = sum(filled[1:], filled[0])
    return profiles.select("user_id", F.round(total * 100.0 / len(fields), 2).alias("completion"))


def user_usage(user_events: DataFrame) -> DataFrame:
    """Scans and verified checks per user."""
    return user_events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == SCAN).alias("scans"),
        F.count_if(F.col("event_type") == VERIFIED).alias("verified"),
    )


def user_rank(usage: DataFrame) -> DataFrame:
    """Rank by scans, 1 = most, ties share.

    The only unpartitioned window runs over the distinct scan counts. n of them
    need at least n(n-1)/2 scans, so there are few however many users there are.
    """
    counts = usage.groupBy("scans").agg(F.count("*").alias("_users"))
    better = F.sum("_users").over(W.orderBy(F.desc("scans"))) - F.col("_users")
    ranks = counts.select("scans", (better + 1).alias("rank"))
    return usage.select("user_id", "scans").join(ranks, "scans")


def profile_card(
    completion: DataFrame, usage: DataFrame, ranks: DataFrame, skills: DataFrame
) -> DataFrame:
    """One row per user with a profile or an event: the figures of the profile window.

    Takes what profile_completion, user_usage, user_rank and profile_skills give. Counts of
    a user without events are 0 and the rank is null; without a profile completion is 0.
    """
    held = skills.groupBy("user_id").agg(F.count("*").alias("skills"))
    return (
        completion.join(usage, "user_id", "full_outer")
        .join(ranks.select("user_id", "rank"), "user_id", "left")
        .join(held, "user_id", "left")
        .fillna(0, ["scans", "verified", "skills"])
        .fillna(0.0, ["completion"])
        .select("user_id", "rank", "completion", "scans", "verified", "skills")
    )


def scan_quota(user_events: DataFrame, subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Mark each scan of a month as within the plan's quota or not.

    Only the first scans of a month decide. They are found with a limit inside the
    plan, so a task passes on a few rows per user and month, and the last allowed
    one becomes a date per month in the user's row. All scans are then moved once,
    to meet that row. A scan without a subscription is not allowed, nor is one without
    a time on a plan with a quota.
    """
    scans = user_events.filter(F.col("event_type") == SCAN).select(
        "event_id", "user_id", "ts", F.date_format("ts", "yyyy-MM").alias("month")
    )
    users = subscriptions.join(
        plans.select(F.col("name").alias("plan"), "scans_per_month"), "plan"
    ).select("user_id", "plan", "scans_per_month")
    # Of several subscriptions of a user the one with the most scans counts.
    best = F.struct(F.col("scans_per_month").isNotNull(), -F.coalesce("scans_per_month", F.lit(0)), "plan")
    users = users.groupBy("user_id").agg(
        F.min_by("plan", best).alias("plan"), F.min_by("scans_per_month", best).alias("scans_per_month")
    )
    largest = plans.agg(F.max("scans_per_month")).first()[0] or 0
    order = W.partitionBy("user_id", "month").orderBy("ts", "event_id")
    last_allowed = (
        scans.filter("month IS NOT NULL").withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= largest)
        .join(users, "user_id")
        .filter(F.col("_rn") <= F.col("scans_per_month"))
        .groupBy("user_id", "month")
        .agg(F.max(F.struct("ts", "event_id")).alias("last"))
        .groupBy("user_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("month", "last"))).alias("_last"))
    )
    quota = users.join(last_allowed, "user_id", "left").withColumn("_known", F.lit(True))
    unlimited = F.col("_known") & F.col("scans_per_month").isNull()
    within = F.struct("ts", "event_id") <= F.try_element_at("_last", F.col("month"))
    return scans.join(quota, "user_id", "left").select(
        "event_id", "user_id", "month", "plan",
        (F.coalesce(unlimited, F.lit(False)) | F.coalesce(within, F.lit(False))).alias("allowed"),
    )


def limited_history(
    user_events: DataFrame, subscriptions: DataFrame, n: int = 10, plans: tuple[str, ...] = ("Free",)
) -> DataFrame:
    """The latest n events of users whose plans are all limited ones, all events of others.

    `rank` counts a limited user's events from the latest; it is null for the others.
    Users without a subscription are limited.
    """
    free = subscriptions.filter(~F.col("plan").isin(*plans)).select("user_id").distinct()
    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    limited = (
        user_events.join(free, "user_id", "left_anti")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    )
    rest = user_events.join(free, "user_id", "left_semi").withColumn("rank", F.lit(None).cast("int"))
    return limited.unionByName(rest)


def session_cells(events: DataFrame, gap_seconds: int, cells_per_gap: int = 30) -> DataFrame:
    """Events folded into cells much shorter than the gap, hence never split."""
    width = max(1_000_000, gap_seconds * 1_000_000 // cells_per_gap)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        events.select("user_id", micros.alias("_t"))
        .groupBy("user_id", F.floor(F.col("_t") / F.lit(width)).cast("long").alias("_cell"))
        .agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.count("*").alias("_n"))
    )


def usage_sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Sessions per user: a pause longer than the gap starts a new one.

    Events fold into cells first, so a user brings at most 30 rows per gap of
    covered time to the window, whatever the number of events.
    """
    if gap_seconds < 30:
        raise ValueError("gap_seconds must be at least 30")
    order = W.partitionBy("user_id").orderBy("_cell")
    pause = F.col("_from") - F.lag("_to").over(order)
    numbered = (
        session_cells(events, gap_seconds)
        .withColumn("_new", F.when(pause <= gap_seconds * 1_000_000, 0).otherwise(1))
        .withColumn("_session", F.sum("_new").over(order))
    )
    return (
        numbered.groupBy("user_id", "_session")
        .agg(
            F.min("_from").alias("_from"),
            F.max("_to").alias("_to"),
            F.sum("_n").alias("events"),
        )
        .select(
            "user_id",
            F.timestamp_micros("_from").alias("session_start"),
            F.timestamp_micros(F.col("_to") + gap_seconds * 1_000_000).alias("session_end"),
            "events",
        )
    )


def purge_records(
    records: DataFrame, deleted_users: DataFrame, cutoff: dt.date, when: str = "ts"
) -> DataFrame:
    """Drop rows older than the cutoff and rows of deleted users."""
    return records.filter(F.col(when) >= F.lit(cutoff)).join(
        deleted_users.select("user_id").distinct(), "user_id", "left_anti"
    )


def redact_text(docs: DataFrame) -> DataFrame:
    """Mask mail addresses and phone numbers before a text is stored."""
    return docs.withColumn("text", masked(F.col("text")))
