"""Alerts for subscribers: limits and subscriptions are read anew for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postvet.operators.scam import HIGH_FROM, Rules
from postvet.streaming.alerts import scam_alerts

# Plans that name alerts among their features.
ENTITLED = ("Pro",)
Reader = Callable[[SparkSession], DataFrame]


def plan_alerts(
    postings: DataFrame, limits: DataFrame, watches: DataFrame, subscriptions: DataFrame,
    rules: Rules = Rules(), threshold: int = HIGH_FROM, entitled: Sequence[str] = ENTITLED,
) -> DataFrame:
    """One alert per user and posting in the high band, for users whose plan has alerts.

    A user is told of companies that they watch: `watches` (user_id, company_id), repeats
    count once. Postings carry company_id, pay, peer and posted_at. A posting that repeats
    is alerted as it stood first, for each company that it names.
    """
    companies = postings.select("posting_id", "company_id").filter("company_id IS NOT NULL").distinct()
    users = (
        watches.select("user_id", "company_id").distinct()
        .join(subscriptions.filter(F.col("plan").isin(*entitled)).select("user_id").distinct(), "user_id")
    )
    told = (
        scam_alerts(postings, limits, rules, threshold)
        .join(companies, "posting_id").join(users, "company_id")
        .select("user_id", "posting_id", "posted_at", "score", "band", "flags")
    )
    return told.dropDuplicates(["user_id", "posting_id"])


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def start_plan_alerts(
    postings: DataFrame, limits: Reader, watches: Reader, subscriptions: Reader, path: str, checkpoint: str,
    rules: Rules = Rules(), threshold: int = HIGH_FROM, entitled: Sequence[str] = ENTITLED, once: bool = False,
) -> StreamingQuery:
    """Write the alerts of each micro-batch of the stream `postings` to a folder of its own under `path`.

    The three readers are called for each micro-batch, so changed limits, watches and plans
    count from the next one on. A batch that is run again replaces its folder. What
    earlier batches have told is not told again: their narrow (user, posting) rows are
    joined, the state is the written table.
    """

    def send(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = plan_alerts(
            batch, limits(spark), watches(spark), subscriptions(spark), rules, threshold, entitled
        )
        if number > 0 and _exists(spark, path):
            told = read_plan_alerts(spark, path).filter(F.col("batch") < number)
            found = found.join(told.select("user_id", "posting_id"), ["user_id", "posting_id"], "left_anti")
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = postings.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_plan_alerts(spark: SparkSession, path: str) -> DataFrame:
    """All alerts written to `path`, with the number of their batch; none if no batch has run yet."""
    schema = "user_id bigint, posting_id bigint, posted_at timestamp, score int, band string, flags array<string>, batch bigint"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
