"""Order within a group, without ever putting a whole group into one task.

Rows are first cut into runs of about equal count: Spark samples the keys and the order
and deals rows by range, so a hot group spreads over as many runs as its share of the rows
asks for, whatever its order values look like. Rows are ordered inside a run; only one
summary row per run and group takes part in the order of the runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postvet.session import stored


def in_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], runs: int | None = None
) -> DataFrame:
    """Stored copy of `df` with `_run`, the number of the row's range of (keys, order).

    The ranges ascend, so `_run` ascends with the order inside every group, also inside a
    finer group of `keys` and more columns. There are as many as shuffle partitions. The rows are
    written, because a range dealt anew could cut elsewhere. Rows equal in keys and order
    share a run.
    """
    runs = runs or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(runs, *keys, *order)
    return stored(ranged.withColumn("_run", F.spark_partition_id()))


def positions_in(cut: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add the 0-based place of each row in its group to a table cut into runs."""
    inside = cut.withColumn(
        "_rn", F.row_number().over(W.partitionBy(*keys, "_run").orderBy(*order))
    )
    before = (
        cut.groupBy(*keys, "_run")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_run")) - F.col("_n"))
        .drop("_n")
    )
    return (
        inside.join(before, [*keys, "_run"])
        .withColumn(name, F.col("_before") + F.col("_rn") - 1)
        .drop("_rn", "_before")
    )


def last_known(cut: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """Fill nulls of `column` with the latest value before them in the group.

    Takes a table cut into runs. A run's last value is carried to the runs after it.
    """
    w = W.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = cut.withColumn("_inside", F.last(column, ignorenulls=True).over(w))
    known = F.when(F.col(column).isNotNull(), F.struct(*order))
    earlier = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    tails = (
        cut.groupBy(*keys, "_run")
        .agg(F.max_by(column, known).alias("_tail"))
        .withColumn("_carried", F.last("_tail", ignorenulls=True).over(earlier))
        .drop("_tail")
    )
    return (
        inside.join(tails, [*keys, "_run"])
        .withColumn(column, F.coalesce("_inside", "_carried"))
        .drop("_inside", "_carried")
    )


def positions(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "pos", runs: int | None = None
) -> DataFrame:
    """Add the 0-based place of each row in its group; `order` is unique in a group."""
    return positions_in(in_runs(df, keys, [order], runs), keys, [order], name).drop("_run")


def with_next(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], runs: int | None = None
) -> DataFrame:
    """Add `next_<column>` from the row that follows in the group, null at its end."""
    w = W.partitionBy(*keys, "_run").orderBy(order)
    cut = (
        in_runs(df, keys, [order], runs)
        .withColumn("_rn", F.row_number().over(w))
        .withColumn("_inside", F.lead(F.struct(*columns)).over(w))
    )
    heads = cut.filter("_rn = 1").select(
        *keys,
        F.lag("_run").over(W.partitionBy(*keys).orderBy("_run")).alias("_run"),
        F.struct(*columns).alias("_head"),
    )
    # A head belongs to the last row of the run before it.
    joined = cut.join(heads.filter(F.col("_run").isNotNull()), [*keys, "_run"], "left")
    follower = F.coalesce("_inside", "_head")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[follower[c].alias(f"next_{c}") for c in columns],
    )
