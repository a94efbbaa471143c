"""Exact quantiles per group for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postvet.session import stored

ACCURACY = 2_000
MARGIN = 2 / ACCURACY
SMALL_GROUP = 10 * ACCURACY
BINS = 4_096


def group_quantile(df: DataFrame, key: str, value: str, q: float, name: str) -> DataFrame:
    """One row per key with the linearly interpolated q-quantile of `value`.

    Built-in `percentile` holds every distinct value of a group in one task.
    Here the wanted rank is boxed in first: a mergeable sketch gives a bracket
    around it, a count per bin of that bracket gives the bin, and only values of
    that bin are ranked. The sketch steers the search and never the result.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must lie in 0..1")
    rows = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).filter(
        F.col("_k").isNotNull() & F.col("_v").isNotNull()
    )
    low, high = max(0.0, q - MARGIN), min(1.0, q + MARGIN)
    sketch = F.percentile_approx("_v", [low, high], ACCURACY)
    bracket = (
        rows.groupBy("_k")
        .agg(
            F.count("*").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"),
            sketch.alias("s"),
        )
        # In a small group the margin is less than one row, so take all of it.
        .select(
            "_k",
            F.when(F.col("n") < SMALL_GROUP, F.col("min")).otherwise(F.col("s")[0]).alias("lo"),
            F.when(F.col("n") < SMALL_GROUP, F.col("max")).otherwise(F.col("s")[1]).alias("hi"),
            ((F.col("n") - 1) * F.lit(float(q))).alias("rank"),
        )
    )
    bracket = stored(bracket)

    share = F.try_divide(F.col("_v") - F.col("lo"), F.col("hi") - F.col("lo"))
    bin_of = (
        F.when(F.col("_v") < F.col("lo"), F.lit(-1))
        .when(F.col("_v") > F.col("hi"), F.lit(BINS))
        .otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS).cast("int"), F.lit(BINS - 1)))
    )
    binned = rows.join(bracket, "_k").withColumn("bin", bin_of)
    # At most BINS + 2 rows per key reach this window.
    ends = F.sum("n").over(W.partitionBy("_k").orderBy("bin"))
    hit = stored(
        binned.groupBy("_k", "rank", "bin")
        .agg(F.count("*").alias("n"))
        .withColumn("start", ends - F.col("n"))
        .filter(
            (F.col("start") <= F.ceil("rank")) & (F.floor("rank") < F.col("start") + F.col("n"))
        )
        .select("_k", "bin", "start")
    )

    # Equal values fold into one row before they are ranked.
    last = F.sum("n").over(W.partitionBy("_k", "bin").orderBy("_v"))
    ranked = (
        binned.join(hit, ["_k", "bin"])
        .groupBy("_k", "rank", "bin", "start", "_v")
        .agg(F.count("*").alias("n"))
        .withColumn("end", F.col("start") + last)
        .withColumn("begin", F.col("end") - F.col("n"))
    )

    def value_at(rank):
        return F.max(F.when((F.col("begin") <= rank) & (rank < F.col("end")), F.col("_v")))

    below, above = value_at(F.floor("rank")), value_at(F.ceil("rank"))
    fraction = F.max(F.col("rank") - F.floor("rank"))
    return ranked.groupBy("_k").agg((below + (above - below) * fraction).alias(name)).withColumnRenamed(
        "_k", key
    )
