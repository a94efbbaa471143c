"""Alerts for postings in the high band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postvet.operators.scam import HIGH_FROM, Rules, scam_analysis


def _hits(postings: DataFrame, limits: DataFrame, rules: Rules, threshold: int) -> DataFrame:
    scored = scam_analysis(postings, None, rules, limits, carry=["posted_at"])
    return scored.filter(F.col("score") >= threshold).select(
        "posting_id", "posted_at", "score", "band", "flags"
    )


def scam_alerts(
    postings: DataFrame,
    limits: DataFrame,
    rules: Rules = Rules(),
    threshold: int = HIGH_FROM,
    delay: str = "7 days",
    salts: int = 16,
) -> DataFrame:
    """Postings at or over the threshold, once per posting.

    Postings carry their pay and peer group; `limits` is the static table of pay
    limits. Scoring needs no state. Works on a stream and on a batch. On a stream, repeats are recognised for as
    long as the watermark allows, so the state does not grow for ever. Repeats of
    one posting are first thinned out in `salts` groups, then across them, so a
    posting sent over and over does not queue up in one task.
    """
    if not postings.isStreaming:
        first = F.struct("posted_at", "score", "band", "flags")
        found = _hits(postings, limits, rules, threshold).groupBy("posting_id").agg(F.min(first).alias("f"))
        return found.select("posting_id", "f.*")
    hits = _hits(postings.withWatermark("posted_at", delay), limits, rules, threshold)
    # A hash of the row, so a batch that is run again keeps the same rows.
    salt = F.pmod(F.xxhash64("posted_at", "score", "flags"), F.lit(salts))
    return (
        hits.withColumn("_salt", salt)
        .dropDuplicatesWithinWatermark(["posting_id", "_salt"])
        .drop("_salt")
        .dropDuplicatesWithinWatermark(["posting_id"])
    )
