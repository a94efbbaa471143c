"""Plans that change over time: the plan valid at an event, quotas, current plans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postvet.functions.ordered import in_runs, last_known, positions_in
from postvet.operators.usage import SCAN

# At one instant a change comes before the events.
ORDER = ["_t", "_kind", "event_id"]


def _most_scans_first() -> Column:
    """Of several plans the one with the most scans counts, then the first by name."""
    return F.struct(F.col("scans_per_month").isNotNull(), -F.coalesce("scans_per_month", F.lit(0)), "plan")


def _changes(plan_changes: DataFrame, plans: DataFrame) -> DataFrame:
    """One change per user and instant: (user_id, valid_from, _plan)."""
    known = plans.select(F.col("name").alias("plan"), "scans_per_month")
    return (
        plan_changes.filter("valid_from IS NOT NULL").join(known, "plan")
        .groupBy("user_id", "valid_from")
        .agg(F.min_by(F.struct("plan", "scans_per_month"), _most_scans_first()).alias("_plan"))
    )


def _valid(events: DataFrame, plan_changes: DataFrame, plans: DataFrame) -> DataFrame:
    """Events (event_id, user_id, ts) in runs, with the plan valid at each.

    Changes and events are one table ordered by time: the last change before an event is
    its plan. A user's rows are cut into runs of equal count, and the last plan of a
    run is carried to the next, so a hot user is spread over many tasks and no change is
    copied to the events it holds for.
    """
    changes = _changes(plan_changes, plans)
    marks = changes.select(
        "user_id", F.col("valid_from").alias("_t"), F.lit(0).alias("_kind"),
        F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), "_plan",
    )
    timed = events.filter("ts IS NOT NULL AND user_id IS NOT NULL").select(
        "user_id", F.col("ts").alias("_t"), F.lit(1).alias("_kind"), "event_id",
        F.lit(None).cast(changes.schema["_plan"].dataType).alias("_plan"),
    )
    cut = in_runs(marks.unionByName(timed), ["user_id"], ORDER)
    return last_known(cut, ["user_id"], ORDER, "_plan").filter("_kind = 1")


def plan_at(events: DataFrame, plan_changes: DataFrame, plans: DataFrame) -> DataFrame:
    """The plan valid at each event: (event_id, user_id, plan).

    `plan_changes` has (user_id, plan, valid_from). A change holds from its instant on; of
    several at one instant the plan with the most scans counts. The plan is null before the
    first change, and for an event without a time or a user. Unknown plans change nothing.
    """
    valid = _valid(events, plan_changes, plans).select("event_id", "user_id", F.col("_plan.plan").alias("plan"))
    rest = events.filter("ts IS NULL OR user_id IS NULL").select(
        "event_id", "user_id", F.lit(None).cast("string").alias("plan")
    )
    return valid.unionByName(rest)


def scan_quota_history(
    user_events: DataFrame, plan_changes: DataFrame, plans: DataFrame
) -> DataFrame:
    """Mark each scan as within the quota of the plan valid at that moment or not.

    All scans of a month count towards its number, whatever plan they were made on. A scan
    without a plan, a time or a user is not allowed.
    """
    scans = user_events.filter(F.col("event_type") == SCAN).select("event_id", "user_id", "ts")
    dated = _valid(scans, plan_changes, plans).withColumn("month", F.date_format("_t", "yyyy-MM"))
    counted = positions_in(dated, ["user_id", "month"], ORDER, "_n")
    quota = F.col("_plan.scans_per_month")
    allowed = F.col("_plan").isNotNull() & (quota.isNull() | (F.col("_n") < quota))
    marked = counted.select(
        "event_id", "user_id", "month", F.col("_plan.plan").alias("plan"), allowed.alias("allowed")
    )
    rest = scans.filter("ts IS NULL OR user_id IS NULL").select(
        "event_id", "user_id", F.date_format("ts", "yyyy-MM").alias("month"),
        F.lit(None).cast("string").alias("plan"), F.lit(False).alias("allowed"),
    )
    return marked.unionByName(rest)


def current_plans(plan_changes: DataFrame, plans: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """The latest plan of each user, as of a moment if one is given."""
    changes = _changes(plan_changes, plans)
    if as_of is not None:
        changes = changes.filter(F.col("valid_from") <= F.lit(as_of))
    return changes.groupBy("user_id").agg(F.max_by("_plan", "valid_from").alias("_p")).select(
        "user_id", F.col("_p.plan").alias("plan")
    )
