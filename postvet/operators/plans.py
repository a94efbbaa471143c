"""Subscription plans: prices, features, charges, team figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "name string, description string, price_monthly int, price_yearly int, "
    "popular boolean, scans_per_month int, features array<string>"
)

# The published plans. `scans_per_month` null means no limit.
PLANS = [
    (
        "Free", "Essential tools for job seekers.", 0, 0, False, 3,
        ["3 Resume Scans per month", "Basic Scam Detection", "Community Support",
         "Limited Job History"],
    ),
    (
        "Pro", "Advanced analytics for serious candidates.", 12, 9, True, None,
        ["Unlimited Resume Scans", "Advanced AI Matching", "Priority Scam Alerts",
         "Company Deep Dive", "24/7 Support"],
    ),
    (
        "Enterprise", "For recruitment agencies and teams.", 59, 49, False, None,
        ["Bulk Analysis API", "Team Dashboard", "Custom Integrations",
         "Dedicated Account Manager", "SLA Support"],
    ),
]


def plan_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, SCHEMA)


def plan_prices(plans: DataFrame) -> DataFrame:
    """Monthly price per plan and billing, and what yearly billing saves."""
    saving = F.round(
        F.try_divide((F.col("price_monthly") - F.col("price_yearly")) * 100.0, "price_monthly"), 1
    )
    return plans.select(
        F.col("name").alias("plan"),
        F.coalesce("popular", F.lit(False)).alias("popular"),
        F.explode(
            F.array(
                F.struct(F.lit("monthly").alias("billing"), F.col("price_monthly").alias("price"),
                         F.lit(0.0).alias("saving_percent")),
                F.struct(F.lit("yearly").alias("billing"), F.col("price_yearly").alias("price"),
                         saving.alias("saving_percent")),
            )
        ).alias("_p"),
    ).select("plan", "popular", "_p.*")


def plan_features(plans: DataFrame) -> DataFrame:
    """One row per plan and feature, in order."""
    return plans.select(F.col("name").alias("plan"), F.posexplode("features").alias("pos", "feature"))


def subscribed_prices(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Price table with the number of subscribers behind each line."""
    used = subscriptions.groupBy("plan", "billing").agg(F.count("*").alias("subscribers"))
    return plan_prices(plans).join(used, ["plan", "billing"], "left").fillna(0, ["subscribers"])


def subscribed_features(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Feature list with the number of users that have each feature."""
    used = subscriptions.groupBy("plan").agg(F.count("*").alias("subscribers"))
    return plan_features(plans).join(used, "plan", "left").fillna(0, ["subscribers"])


def subscription_charges(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Monthly charge per user."""
    prices = plan_prices(plans).select("plan", "billing", "price")
    return subscriptions.join(prices, ["plan", "billing"]).select(
        "user_id", "plan", "billing", F.col("price").alias("charge")
    )


def charge_totals(charges: DataFrame) -> DataFrame:
    """Users and monthly income per plan and billing."""
    return charges.groupBy("plan", "billing").agg(
        F.count("*").alias("users"), F.sum("charge").alias("total")
    )


def team_dashboard(report: DataFrame, teams: DataFrame) -> DataFrame:
    """Postings and mean risk by team and band with subtotals.

    Folded to (team, band) first, so the subtotals expand a small table.
    """
    folded = (
        report.select("posting_id", "band", "score")
        .join(teams.select("posting_id", "team"), "posting_id")
        .groupBy("team", "band")
        .agg(
            F.count("*").alias("_n"), F.count("score").alias("_scored"), F.sum("score").alias("_sum")
        )
    )
    return folded.rollup("team", "band").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("_n").alias("postings"),
        F.round(F.try_divide(F.sum("_sum"), F.sum("_scored")), 4).alias("mean_score"),
    )
