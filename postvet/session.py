"""Session set-up and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on; all of them can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even if that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Compressed files grow in memory; joins judge a side by its grown size.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # Let top-k limits of up to this many rows work before the exchange.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # Rows and bytes in one Arrow batch: texts can be 100 KB and more.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # Fold a hot user's sessions inside each input task before the exchange.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


# Delete a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "postvet", master: str | None = None, **conf: str) -> SparkSession:
    """New session with our settings; on a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by `spark.checkpoint.dir`.

    Only a local-mode session may fall back on a folder of this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="postvet-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def new_shared_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, rebalance: bool = False) -> DataFrame:
    """Write `df` once to the shared folder and read it from there.

    The lineage ends at files that outlive any executor. Later plans see the true
    size of the table, so Spark broadcasts it only if it is under
    `spark.sql.autoBroadcastJoinThreshold`; a larger one is joined by a shuffle
    whose hot partitions AQE splits. Nothing is hinted.

    The shuffle files of the write go with it; they would stay until the driver collects
    garbage.

    Set `rebalance` for a narrow table that comes straight from a scan: it would
    otherwise be written as one small file per read task.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, "stored")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.hint("rebalance") if rebalance else df).write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
